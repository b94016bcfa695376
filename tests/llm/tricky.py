"""A table of documents with every awkward case, for all operators and stages."""

import random

WORDS = "the of and to in that river stone window garden letter music winter copper market silver yellow".split()


def text(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (rng.choice("abcdefgh") * rng.randint(0, 2)) + ("." if rng.random() < 0.1 else "") for _ in range(n))


LONG = text(99, 60_000) + "\n" + "x" * 300_000 + "\n" + text(98, 1000)

ROWS = [
    (1, text(1, 200), "en", "a", 0),
    (2, text(1, 200), "en", "a", 0),  # the same text
    (3, text(3, 150) + "\n" + text(4, 20), "en", "b", 0),
    (3, text(3, 150) + "\n" + text(4, 20), "en", "b", 0),  # a repeated row
    (3, text(5, 80), "en", "b", 0),  # the id again with another text
    (4, "", "en", "b", 0),
    (5, None, None, None, None),
    (None, text(6, 60), "de", None, 1),
    (None, "", "de", "", 1),
    (None, None, None, None, None),
    (7, " \t\n\x0b\x0c\r ", "fr", "c", 7),
    (8, "Élève ß \U0001f600 token = 'abcdefgh12345' KKng", "fr", "c", 3),
    (9, LONG, "en", "c", 1),
    (10, "one", "en", "é", 3),
    (20, text(7, 300), "en", "a", 5),
    (40, text(8, 300), "en", "a", 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators might use themselves.
CLASHES = {
    "size": 1, "cell": "c", "block": 2, "_text": "t", "_key": "k", "_id": 3, "_kinds": "z", "_statistics": 0.5, "score": "s", "copies": 9,
    "fp": 1, "label": 2.0, "words": 3, "hash": 4, "tail": True, "target": "w", "found": 6, "_size": 1, "_each": 2, "_nth": 3, "_copies": 4, "quality": 0,
}


def documents(spark, clashes: bool = True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    return df.withColumns({k: F.lit(v) for k, v in CLASHES.items()}) if clashes else df


def empty(spark):
    return documents(spark).limit(0)
