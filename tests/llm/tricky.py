"""Small documents tables with the cases every operator must bear."""

from pyspark.sql import functions as F

PROSE = "the river ran past an old mill and the miller watched it turn all day while rain fell on the roof".split()


def prose(seed: int, n: int) -> str:
    """n words, different for each seed."""
    out, x = [], seed * 7919 + 13
    for i in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(PROSE[x % len(PROSE)] + ("" if x % 3 else chr(97 + x % 26) + chr(97 + (x >> 5) % 26)))
        if i % 12 == 11:
            out[-1] += ".\n" if x % 2 else "."
    return " ".join(out)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls in every column, empty and blank texts, one text thrice, a repeated row, a text with every kind of space.
ROWS = [
    (1, prose(1, 80), "en", "a", 1), (2, prose(2, 120), "de", "a", 1), (3, prose(1, 80), "en", "b", 1),
    (4, None, "en", "a", None), (5, "", None, "a", 0), (6, " \n\t ", "fr", None, 4), (None, prose(3, 60), "en", "a", 1),
    (None, None, None, None, None), (7, prose(4, 70), "en", "a", 1), (7, prose(4, 70), "en", "a", 1),
    (8, "one", "en", "a", 3), (9, "a  b\r\n c\x0bd\x0ce  f　g x\x1cy é ß 😀 it's 12 3", "fr", "a", 9),
    (10, prose(5, 20_000), "en", "a", 9), (11, "#*$%&|<>\n#*$%&|<>\n\n", "en", "a", 9), (12, prose(1, 80).upper(), "en", "a", 9),
]


def tricky(spark):
    """The rows, with extra columns whose names operators use themselves."""
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for name in ("size", "shard", "row", "key", "ids", "score", "label", "bucket_", "print", "n", "kept", "levels"):
        df = df.withColumn(name, F.lit("extra"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
