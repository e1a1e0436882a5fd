"""Awkward tables that every operator takes."""

import random

TYPES = "doc_id long, text string, lang string, source string, n_chars long, rep string, size string, label string, spans string, shard string"


def awkward(spark, texts=None):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = prose(60)
    rows = [
        (1, shared), (2, shared), (3, shared + " end"), (4, None), (5, ""), (6, "   \n\t"), (7, prose(40)), (7, prose(40)), (8, prose(30)), (8, None), (None, shared), (None, None), (9, "x"), (10, "é漢😀 " * 30),
        (11, prose(20_000)), (12, "a" * 50_000), (13, " " * 5_000), (14, "<|endoftext|> a <|endoftext|>"), (15, "line\n" * 50), *((100 + i, t) for i, t in enumerate(texts or [])),
    ]
    full = [(d, t, None if d == 3 else "en", "s", None if t is None else len(t), "r", "s", None, "x", "y") for d, t in rows]
    return spark.createDataFrame(full, TYPES)


def empty(spark):
    return awkward(spark).limit(0)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
