"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ignis.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The same rows read from a checkpoint in the shared folder: lineage ends
    here, and what follows reads the rows instead of making them again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fold(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % folds


def in_fold(k: int, doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether the id falls in fold k; false for a null id."""
    return F.coalesce(fold(doc_id, folds) == k, F.lit(False))


def spare(docs: DataFrame, *names: str) -> list[str]:
    """Names like those asked for that are no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: A key with more than this share of the rows is dealt to several tasks.
HOT_SHARE = 1 / 256


def hot_join(big: DataFrame, small: DataFrame, keys: Sequence[str], weight: str, by: Sequence[str]) -> DataFrame:
    """Inner join of ``big`` with ``small`` (one row a key; ``weight``, which the
    result leaves out, is how many rows of ``big`` have the key) where one key may
    hold much of ``big``: a hot key's rows are dealt by a hash of the columns
    ``by``, and its row of ``small`` is copied for each part.  At most
    1 / HOT_SHARE keys can be hot, so their list is broadcast."""
    copies, salt = spare(big, "copies", "salt")
    total = small.agg(F.sum(weight)).first()[0] or 0
    least = F.lit(max(1.0, total * HOT_SHARE))
    parts = F.ceil(F.col(weight) / least).cast("int")
    hot = small.where(F.col(weight) > least).select(*keys, parts.alias(copies))
    dealt = big.join(F.broadcast(hot), list(keys), "left").withColumn(
        salt, F.coalesce(F.pmod(F.xxhash64(*by), F.col(copies)).cast("int"), F.lit(0))).drop(copies)
    spread = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.when(F.col(weight) > least, parts).otherwise(1) - 1))).drop(weight)
    return dealt.join(spread, [*keys, salt]).drop(salt)
