"""Odd rows that every operator must take."""

import random

WORDS = "the of and to in is it that was for on are as with his they be at one have this".split()


def texts(n=30, seed=1):
    rng = random.Random(seed)
    made = [" ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(rng.randint(1, 60))) + "." for _ in range(n)]
    return [*made, made[0], made[1], made[1], None, "", " \n\t", "x", "日本語テスト \U0001f600é́", "word. " * 9000]


def documents(spark, rows=None, extra=True):
    """doc_id and text, with repeated rows, a null id, and columns whose names operators use inside."""
    rows = list(enumerate(texts())) if rows is None else rows
    rows = [*rows, *rows[:1], (None, "the null one is here")] if extra else rows
    names = ["size", "n", "fp", "words", "ids", "score", "quality", "kept", "a.b", "root", "tie", "bundle"] if extra else []
    schema = "doc_id long, text string" + "".join(f", `{c}` int" for c in names)
    return spark.createDataFrame([(i, t, *[7] * len(names)) for i, t in rows], schema)


def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")
