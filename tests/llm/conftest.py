import random

import pytest

WORDS = "amber basil cedar delta ember fjord grove haven inlet jolly karst lemon maple north ocean pearl quartz river stone tidal".split()


def prose(seed, n):
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + pick.choice(["", "", "s", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids, and columns whose names clash."""
    base = prose(1, 120)
    rows = [
        (1, base), (2, base), (3, base.replace(" ", "\t ")), (4, base.replace("river", "brook", 1)), (5, None), (6, ""), (7, "  \n\x0b\r\n "), (8, None),
        (9, prose(2, 9000)), (10, prose(3, 80) + "\n" + base), (10, prose(3, 80) + "\n" + base), (11, "short"), (11, "other short"), (None, prose(4, 40)),
        (None, base), (12, "x" * 700 + "é" * 300), (13, "The same line stands in many documents here\n" + prose(5, 30)),
        (14, prose(6, 30) + "\n the same line stands in MANY documents here \t"), (15, "The same line stands in many documents here"),
        (16, "日本語 Ωmega ünder <|endoftext|> don't  stop now 123 45.6kg\n\n\nend '"), (17, "1234 !!! ..."), (18, base[:300] + prose(7, 60)),
    ]
    extra = "key string, chunk long, hash string, digest binary, n int, bucket int, kind string, text_sha256 string, size long, part int, rank long, lang string, source string, n_chars long"
    some = [(i, t, None, 1, "h", b"d", None, 2, "k", "s", 3, 4, None, [None, "en", "fr"][k % 3], "src", len(t or "")) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(some, f"doc_id long, text string, {extra}")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
