"""Fixtures: documents with every awkward case, in a table with columns whose names the operators use inside."""

import random

CLASHES = ("hash", "leaf", "content", "node", "size", "shard", "slot", "kind", "bucket", "batch", "score", "label", "part", "at", "n", "_id", "row", "held_out")


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


def awkward(seed=1):
    """(doc_id, text): nulls, empty and blank texts, a long one, copies, case copies, near copies, repeated rows."""
    rng = random.Random(seed)
    base = [sentence(rng, 60) for _ in range(8)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(10, base[0]), (11, base[0].upper()), (12, base[1] + " tail"), (13, None), (14, ""), (15, " \t\n "), (16, "one"), (17, "Two Words"), (18, "two words")]
    rows += [(None, base[2]), (None, None), (20, base[3]), (20, base[3]), (20, base[4]), (21, "é ü ß 日本語 🙂 " * 3), (22, sentence(rng, 30_000)), (23, " x y z w v")]
    return rows


def frame(spark, rows, extra=True):
    names = "doc_id long, text string, lang string, source string, n_chars long"
    data = [(i, t, "en" if (i or 0) % 3 else None, f"src{(i or 0) % 4}", None if t is None else len(t)) for i, t in rows]
    df = spark.createDataFrame(data, names)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("clash") for c in CLASHES})
    return df
