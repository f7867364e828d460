"""Command-line options of the app and the strict grammars of their values."""

from __future__ import annotations

import argparse
import re

NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


def numbers(text: str) -> list[float]:
    """`x`, `[a,b]`, `[a b]`, `(a,b)`, `a:b` or `a:step:b`."""
    t = text.strip()
    if re.fullmatch(NUMBER, t):
        return [float(t)]
    if re.fullmatch(rf"{NUMBER}(:{NUMBER}){{1,2}}", t):
        p = [float(x) for x in t.split(":")]
        lo, step, hi = (p[0], 1.0, p[1]) if len(p) == 2 else p
        if step == 0:
            raise ValueError(f"step 0 in {text}")
        return [lo + step * i for i in range(int((hi - lo) / step + 1e-9) + 1)]
    m = re.fullmatch(r"\[(.*)\]|\((.*)\)", t)
    parts = re.split(r"\s*[,;]\s*|\s+", ((m[1] or m[2] or "") if m else "?").strip())
    if not m or not all(re.fullmatch(NUMBER, x) for x in parts):
        raise ValueError(f"{text} is not a number, list or range")
    return [float(x) for x in parts]


def echoes(tokens: list[str], count: int) -> list[int]:
    text = " ".join(tokens).strip()
    if text in (":", "[:]"):
        return list(range(1, count + 1))
    try:
        found = numbers(text)
    except ValueError:
        raise ValueError(f"echoes={text} wrongly formatted!") from None
    if any(x != int(x) for x in found):
        raise ValueError(f"echoes={text} wrongly formatted!")
    if any(not 1 <= x <= count for x in found):
        raise ValueError(f"echoes={text}: specified echo out of range! Number of echoes is {count}")
    return [int(x) for x in found]


def echo_times(tokens: list[str], count: int, chosen: list[int] | None) -> list[float]:
    """Times of the chosen echoes (all if None)."""
    if not tokens:
        if count == 1 or (chosen is not None and len(chosen) == 1):
            return [1.0]
        raise ValueError("multi-echo data is used, but no echo times are given. Please specify the echo times using the -t option.")
    if tokens[0] == "epi":
        tes = [float(tokens[1]) if len(tokens) > 1 else 1.0] * count
    else:
        tes = numbers(" ".join(tokens))
    if chosen is not None and 1 < len(tes) == count:
        tes = [tes[e - 1] for e in chosen]
    return tes


def smoothing(tokens: list[str]) -> tuple[float, ...]:
    return tuple(numbers(" ".join(tokens))) if tokens else (7.0, 7.0, 7.0)


class Parser(argparse.ArgumentParser):
    def error(self, message: str):
        if "unrecognized arguments" in message:
            print("wrong argument formatting!")
        super().error(message)


def parser(version: str) -> Parser:
    p = Parser(prog="unfurl")
    add = p.add_argument
    add("--phase", "-p", help="phase image to unwrap")
    add("--magnitude", "-m", help="magnitude image")
    add("--output", "-o", default="unwrapped.nii", help="output folder or .nii/.nii.gz file")
    add("--echo-times", "-t", nargs="+", default=[], help="echo times in ms: list, range, `epi` or `epi x`")
    add("--mask", "-k", nargs="+", default=["robustmask"], help="nomask, qualitymask [threshold], robustmask or a file")
    add("--mask-unwrapped", "-u", action="store_true", help="apply the mask to the result")
    add("--unwrap-echoes", "-e", nargs="+", default=[":"], help="echoes to unwrap")
    add("--weights", "-w", default="default", help="default, default2/3/4/6, bestpath, up to 6 bits, or a 4-D weights file")
    add("--compute-B0", "-B", nargs="?", const="B0", default="", help="also write a field map in Hz")
    add("--B0-phase-weighting", default="phase_snr", help="phase_snr, phase_var, average, TEs, mag, simulated_mag")
    add("--phase-offset-correction", nargs="?", const="on", default="default off", help="on, off or bipolar")
    add("--phase-offset-smoothing-sigma-mm", nargs="+", default=[], help="smoothing of phase offsets in mm")
    add("--write-phase-offsets", action="store_true")
    add("--individual-unwrapping", "-i", action="store_true", help="unwrap echoes one by one")
    add("--template", type=int, default=1, help="echo that is unwrapped spatially")
    add("--no-mmap", "-N", action="store_true", help="accepted; files are read by Spark")
    add("--no-phase-rescale", "--no-rescale", action="store_true", help="do not rescale the phase to [-pi, pi]")
    add("--fix-ge-phase", action="store_true", help="repair slice jumps")
    add("--threshold", type=float, default=float("inf"), help="values beyond so many wraps become 0")
    add("--verbose", "-v", action="store_true")
    add("--correct-global", "-g", action="store_true")
    add("--write-quality", "-q", action="store_true")
    add("--write-quality-all", "-Q", action="store_true")
    add("--max-seeds", "-s", type=int, default=1)
    add("--merge-regions", action="store_true")
    add("--correct-regions", action="store_true")
    add("--wrap-addition", type=float, default=0.0)
    add("--temporal-uncertain-unwrapping", nargs="?", type=float, const=0.5, default=0.0)
    add("--version", action="version", version=version)
    return p


def parse(args: list[str], version: str) -> argparse.Namespace:
    """The phase may also be the first or the last argument, without -p."""
    args = list(args) or ["--help"]
    if args != ["--help"]:
        if "-" not in args[0]:
            args = ["-p", *args]
        if len(args) >= 2 and not {"-p", "--phase"} & set(args) and "-" not in args[-2]:
            args = [*args[:-1], "-p", args[-1]]
    return parser(version).parse_args(args)
