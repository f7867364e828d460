import random

import pytest

WORDS = "the of and to in is on that by with from are erand thion onest ingly atore".split()


@pytest.fixture(scope="session")
def corpus(spark):
    """About 90 small texts: plain, copied, edited, sharing passages, junk, empty,
    null, repeated rows, one very long, with null ids, languages and sources."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "", "x%d" % rng.randrange(40)]) for _ in range(n))
    rows, passage = [], text(60)
    for i in range(40):
        rows.append((i, text(rng.randrange(30, 90)), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", "d"])))
    for i in range(12):
        base = rows[i % 4][1].split(" ")
        base[rng.randrange(len(base))] = "edit%d" % i
        rows.append((100 + i, " ".join(base), "en", "a"))
    for i in range(8):
        rows.append((200 + i, text(8) + " " + passage + " " + text(8), "en", None))
    for i in range(8):
        rows.append((300 + i, rows[5][1], "en", "a"))
    rows += [(400, "", "en", "b"), (401, None, None, None), (402, "  \n\t ", "en", "b"), (403, "one two", "en", "b"), (404, "ONE two", "en", "b")]
    rows += [(405, "É ü ñ " * 30, "de", "c"), (406, "a " * 300, "en", "c"), (None, text(20), "en", "a"), (407, "x" * 70000, "en", "a")]
    rows += [(408, text(9000), "en", "a"), (409, "# $ % | word\n" * 20, "en", "d"), rows[7], rows[7]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    df.cache().count()
    return df, rows


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
