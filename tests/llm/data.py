"""Small documents with the cases every operator must handle."""

import random

WIDE = "doc_id long, text string, lang string, source string, n_chars long, id string, k string, fp long, size long, tie long, score double, label int"


def wide(spark, rows):
    """Documents with extra columns that clash with names used inside the operators."""
    made = [(i, t, g, "s", None if t is None else len(t), "x", None, 1, 2, None, 0.5, 3) for i, t, g in rows]
    return spark.createDataFrame(made, WIDE)


def words(rng, n, alphabet="abcdeé"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))) for _ in range(n))


def awkward(seed=5):
    """(id, text, lang): nulls, empty texts, a very long one, ties, repeated rows, exact and near copies."""
    rng = random.Random(seed)
    base = [(i, words(rng, rng.randint(0, 120)), "en") for i in range(40)]
    long = words(rng, 30_000)
    near = base[3][1] + " tail"
    extra = [(50, None, None), (51, "", "en"), (52, "   ", "en"), (53, long, "en"), (54, long.upper(), "en"), (55, near, "fr"), (55, near, "fr"), (56, "ÀÉ é", "fr")]
    return base + extra + [(60, base[7][1], "en"), (None, base[8][1], "en"), (None, None, None), (61, "!!! 123", None)]
