import random

import pytest

NASTY = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, slot int, copies int, keep_id int, unit int, block int, a int, b int, h int"


def words(r, n):
    return " ".join("".join(r.choice(["th", "er", "on", "an", "re", "ha", "ou", "st", "la", "ko"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def nasty_rows():
    """Nulls in every column, empty and very long texts, exact and near copies, ties, repeated rows and ids."""
    r = random.Random(4)
    base = [words(r, 60) for _ in range(12)]
    long_ = words(r, 30_000)
    rows = [(i, t, "en", f"src{i % 3}") for i, t in enumerate(base)]
    rows += [(100 + i, base[i % 4], "en", "src0") for i in range(9)]
    rows += [(200 + i, " ".join(w if j != 7 + i else "zzz" for j, w in enumerate(base[5].split())), "en", "src1") for i in range(6)]
    rows += [(300, "", "en", "src1"), (301, "", None, "src1"), (302, None, "en", "src2"), (303, None, None, None), (None, base[0], "en", None), (None, base[0], "en", None), (None, None, None, None)]
    rows += [(400, long_, "en", "src2"), (401, long_, "en", "src2"), (402, long_ + " tail", "en", "src2"), (403, "x" * 5000, "en", "src2"), (404, "...!!", "en", "src0"), (405, "one", "en", "src0"), (406, "one", "en", "src0"), (407, "Ünïcödé 日本語 🙂", "en", "src0")]
    rows += [(0, base[0], "en", "src0")] * 2 + [(1, base[7], "en", "src1"), (2, "different text of one id", "en", "src2")]
    return [(i, t, l, s, None if t is None or i == 5 else len(t), "x", 1, 2, 3, 4, 5, 6, 7, 8) for i, t, l, s in rows]


@pytest.fixture(scope="session")
def nasty(spark, nasty_rows):
    return spark.createDataFrame(nasty_rows, NASTY).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], NASTY)
