"""Merkle manifest of a data set, with proofs, over bitmap ranks.

Each row is a leaf, the digest of its fields.  Leaves of a group (a language)
stand in the order of their ids; every FAN consecutive nodes become one, up to
the group's subroot, and the subroots, in the order of the groups, likewise
become the root.

A leaf's place needs no sort: each group has a compressed bitmap of its ids (64
ids a word, words without an id are not stored), merged over all tasks by a
bitwise or, and a popcount directory of running counts, a trie of 16 bits a step,
so no window ever holds more than 65,536 entries.  The place is the directory's
count before the word plus the bits below the id in it.  Ids that several rows
share count by their number, and are told apart by leaf.

A node goes to a slot (its place modulo the block) of an array under a key (group,
block); a task fills the arrays and reduces LEVELS levels in each, and only the
arrays' tops go on.  Paths to the root come down the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ignis.llm.common import cut, hot_join
from ignis.operators.prefix import dense_rank_values

#: Nodes of a run; levels that a slot array reduces, so that it has FAN ** LEVELS slots.
FAN, LEVELS = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = 16
_NULL_WORD = -(1 << 58)  # below the word of any id
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of the fields: ``-`` for a null, else the value's
    length in UTF-8 bytes, a colon and the value."""
    coded = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*coded).cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, and nothing else."""
    return F.translate(text, _UPPER, _LOWER)


def leaves(docs: DataFrame, claimed: Column | None = None, fields: Sequence[str] = FIELDS, id_col: str = "doc_id",
           group_col: str = "lang") -> DataFrame:
    """g (the group as a key: empty for null, else ``+`` and the value), id, leaf and
    claimed (the leaf that somebody claims to hold, null where it is the same)."""
    group = F.col(group_col).cast("string")
    return docs.select(F.coalesce(F.concat(F.lit("+"), group), F.lit("")).alias("g"), F.col(id_col).cast("long").alias("id"),
                       digest(*[F.col(c) for c in fields]).alias("leaf"),
                       (F.lit(None).cast("string") if claimed is None else claimed).alias("claimed"))


def _running(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> Column:
    """Sum of ``value`` over the earlier entries."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def bitmaps(rows: DataFrame) -> DataFrame:
    """The groups' bitmaps with their directory: g, word, bits, extra (of ids that
    several rows share: bit, and rows beyond one), rows, before (rows of the group
    in earlier words) and n (rows of the group)."""
    merged = cut(rows.groupBy("g", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"),
                                               F.count("*").alias("rows")))
    shared = merged.where("rows > bit_count(bits)").select("g", "word", F.col("rows").alias("weight"))
    more = (hot_join(rows.select("g", "word", "bit", "row"), shared, ["g", "word"], "weight", ["row"])
            .groupBy("g", "word", "bit").agg((F.count("*") - 1).alias("extra")).where("extra > 0"))
    extra = more.groupBy("g", "word").agg(F.collect_list(F.struct("bit", "extra")).alias("extra"))  # 64 entries at most
    steps = [merged.select("g", F.col("word").alias("k0"), F.col("word").alias("key"), "rows")]
    for _ in range(3):
        up = steps[-1].groupBy("g", F.shiftright("key", _STEP).alias("up")).agg(F.sum("rows").alias("rows"))
        steps.append(cut(up.select("g", F.col("up").alias("key"), "rows")))
    top = steps[-1]
    before = top.select("g", "key", _running(top, ["g"], ["key"], "rows").alias("before"))
    for level in (2, 1, 0):
        own = steps[level].select("g", "key", F.shiftright("key", _STEP).alias("up"), "rows")
        own = own.select("g", "key", "up", _running(own, ["g", "up"], ["key"], "rows").alias("inside"))
        before = own.join(before.select("g", F.col("key").alias("up"), "before"), ["g", "up"]).select(
            "g", "key", (F.col("before") + F.col("inside")).alias("before"))
    sizes = top.groupBy("g").agg(F.sum("rows").alias("n"))
    return cut(merged.join(before.withColumnRenamed("key", "word"), ["g", "word"]).join(extra, ["g", "word"], "left").join(sizes, "g"))


def coordinates(found: DataFrame) -> DataFrame:
    """g, id, leaf, claimed, pos (the leaf's place in its group, from 0) and n
    (leaves of the group) of rows of ``leaves``: in the order of ids, null first;
    rows with one id in the order of their leaves; equal rows in any order."""
    rows = cut(found).withColumn("row", F.monotonically_increasing_id()).withColumn(
        "word", F.coalesce(F.shiftright("id", 6), F.lit(_NULL_WORD))).withColumn("bit", F.coalesce(F.col("id").bitwiseAND(63), F.lit(0)).cast("int"))
    maps = bitmaps(rows)
    below = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.expr("shiftleft(-1L, bit)"))))
    shared = F.coalesce(F.col("extra"), F.array().cast("array<struct<bit:int,extra:bigint>>"))
    lower = F.aggregate(F.filter(shared, lambda e: e["bit"] < F.col("bit")), F.lit(0).cast("long"), lambda a, e: a + e["extra"])
    ranked = cut(hot_join(rows, maps, ["g", "word"], "rows", ["row"]).select(
        "g", "id", "leaf", "claimed", "n", "row", "word", "bit", (F.col("before") + below + lower).alias("pos"),
        F.exists(shared, lambda e: e["bit"] == F.col("bit")).alias("tied")))
    kept = ["g", "id", "leaf", "claimed", "pos", "n"]
    # rows of one id: counts by leaf and partition, summed under the leaf's first 16 bits
    tied = ranked.where("tied").withColumn("part", F.shiftright("row", 33)).withColumn("head", F.substring("leaf", 1, 4))
    one = ["g", "word", "bit"]
    counts = tied.groupBy(*one, "head", "leaf", "part").agg(F.count("*").alias("rows"))
    heads = counts.groupBy(*one, "head").agg(F.sum("rows").alias("rows"))
    heads = heads.select(*one, "head", _running(heads, one, ["head"], "rows").alias("earlier"))
    spots = counts.select(*one, "head", "leaf", "part", _running(counts, [*one, "head"], ["leaf", "part"], "rows").alias("inside")).join(
        heads, [*one, "head"])
    local = F.row_number().over(Window.partitionBy(*one, "head", "leaf", "part").orderBy("row")) - 1
    apart = tied.withColumn("local", local).join(spots, [*one, "head", "leaf", "part"]).withColumn(
        "pos", F.col("pos") + F.col("earlier") + F.col("inside") + F.col("local"))
    return cut(ranked.where("NOT tied").select(*kept).unionByName(apart.select(*kept)))


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _heights(n: int, most: int) -> int:
    """Levels that an array of a group of n nodes reduces, ``most`` where there are several arrays."""
    if n > FAN ** most:
        return most
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _reduce(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of an array, level by level; the last holds its top."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([h("".join(below[i:i + FAN])) for i in range(0, len(below), FAN)])
    return out


def _arrays(rows: pd.DataFrame, size: int) -> Iterator[tuple[str, int, int, pd.DataFrame]]:
    """(g, block, n, rows by slot) of each array among a part's rows."""
    rows = rows.assign(block=rows["pos"] // size).sort_values(["g", "pos"], kind="stable")
    for (g, block), own in rows.groupby(["g", "block"], sort=False):
        yield g, int(block), int(own["n"].iloc[0]), own


def _part(block: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64("g", block), F.lit(parts)).cast("int")


def reduced(nodes: DataFrame, deep: int = LEVELS) -> list[DataFrame]:
    """Levels of arrays: (g, pos, n, digest) of the given nodes, then of the tops
    of their arrays, and so on until each group has one node."""
    out, size = [nodes], FAN ** deep
    while True:
        rows, most = out[-1].agg(F.count("*"), F.max("n")).first()
        if (most or 0) <= 1:
            return out
        parts = -(-rows // size)
        def tops(own: pd.DataFrame) -> pd.DataFrame:
            made = [(g, block, -(-n // size), _reduce(slots["digest"].tolist(), _heights(n, deep))[-1][0])
                    for g, block, n, slots in _arrays(own, size)]
            return pd.DataFrame(made, columns=["g", "pos", "n", "digest"])
        block = F.floor(F.col("pos") / size).cast("long")
        out.append(cut(out[-1].where("n > 1").select("g", "pos", "n", "digest", _part(block, parts).alias("part"))
                       .groupBy("part").applyInPandas(tops, "g string, pos long, n long, digest string")))


def _local_paths(levels: list[list[str]]) -> Iterator[list[tuple[str, str]]]:
    """For each slot, from the bottom up: its run's digests before and after it."""
    for slot in range(len(levels[0])):
        path = []
        for nodes in levels[:-1]:
            run = slot // FAN * FAN
            path.append(("".join(nodes[run:slot]), "".join(nodes[slot + 1:run + FAN])))
            slot //= FAN
        yield path


def _descend(nodes: DataFrame, above: DataFrame, make: Callable, schema: str, deep: int, extra: Sequence[str] = ()) -> DataFrame:
    """Rows made of each node and its path to the root: ``above`` holds (g, pos of
    the array, lefts, rights, subroot, root) of the arrays' tops."""
    size = FAN ** deep
    parts = -(-nodes.count() // size) or 1
    block = F.floor(F.col("pos") / size).cast("long")
    left = nodes.select("g", "pos", "n", "digest", *extra, _part(block, parts).alias("part"))
    right = above.select(F.col("g").alias("of"), F.col("pos").alias("block"), "lefts", "rights", "subroot", "root", _part(F.col("pos"), parts).alias("to"))
    def down(own: pd.DataFrame, tops: pd.DataFrame) -> pd.DataFrame:
        known = {(g, int(b)): (list(zip(ls, rs)), s, r) for g, b, ls, rs, s, r in
                 zip(tops["of"], tops["block"], tops["lefts"], tops["rights"], tops["subroot"], tops["root"])}
        out = []
        for g, block_, n, slots in _arrays(own, size):
            path, subroot, root = known[g, block_]
            levels = _reduce(slots["digest"].tolist(), _heights(n, deep))
            columns = [slots[c].tolist() for c in ("g", "pos", "digest", *extra)]
            out += [make(row, local + path, subroot, root) for row, local in zip(zip(*columns), _local_paths(levels))]
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")], dtype=object)
    return left.groupBy("part").cogroup(right.groupBy("to")).applyInPandas(down, schema)


_PATHS = "g string, pos long, lefts array<string>, rights array<string>, subroot string, root string"


def _path_row(row, path, subroot, root):
    return (row[0], row[1], [x for x, _ in path], [y for _, y in path], subroot, root)


def _paths(levels: list[DataFrame], top: DataFrame, deep: int) -> DataFrame:
    """Paths of the tops of the lowest level's arrays, from those of the groups'
    last nodes (``top``): (g, pos of the array, lefts, rights, subroot, root)."""
    top = top.withColumn("pos", F.lit(0).cast("long"))
    ends = lambda level: level.where("n = 1").select("g").join(top, "g")  # noqa: E731  groups whose last node this is
    above = ends(levels[-1])
    for i in range(len(levels) - 1, 0, -1):
        paths = above if i == len(levels) - 1 else cut(_descend(levels[i], above, _path_row, _PATHS, deep))
        above = ends(levels[i - 1]).unionByName(paths)
    return above


def manifest(placed: DataFrame, deep: int = LEVELS) -> DataFrame:
    """g, id, leaf, subroot, root, proof (SHA-256 of the siblings from the leaf to
    the root, each run's others left to right), folded (the root as recomputed from
    the claimed leaf and the siblings) and verified (it is the root) of rows of
    ``coordinates``."""
    nodes = placed.withColumnRenamed("leaf", "digest")
    levels = reduced(nodes.select("g", "pos", "n", "digest"), deep)
    subroots = levels[0].where("n = 1")
    for level in levels[1:]:
        subroots = subroots.unionByName(level.where("n = 1"))
    subroots = cut(subroots.select("g", "digest"))
    groups = subroots.count()
    order = dense_rank_values(subroots.select("g"), "g", "at")
    upper = cut(subroots.join(order, "g").select(F.lit("").alias("g"), F.col("at").cast("long").alias("pos"), F.lit(groups).cast("long").alias("n"),
                                                 "digest", F.col("g").alias("own")))
    rising = reduced(upper.select("g", "pos", "n", "digest"), deep)
    none = F.array().cast("array<string>")
    root = rising[-1].where("n = 1").select("g", none.alias("lefts"), none.alias("rights"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    def group_row(row, path, _, root_):
        return (row[3], [x for x, _ in path], [y for _, y in path], row[2], root_)
    top = cut(_descend(upper, _paths(rising, root, deep), group_row,
                       "g string, lefts array<string>, rights array<string>, subroot string, root string", deep, ["own"]))

    def leaf_row(row, path, subroot, root_):
        g, _, leaf, id_, claimed = row
        folded = claimed or leaf
        for before, after in path:
            folded = h(before + folded + after)
        return (g, id_, leaf, subroot, root_, h("".join(x + y for x, y in path)), folded, folded == root_)
    return _descend(nodes.withColumn("id", F.col("id").cast("string")), _paths(levels, top, deep), leaf_row,
                    "g string, id string, leaf string, subroot string, root string, proof string, folded string, verified boolean",
                    deep, ["id", "claimed"])


def audit(docs: DataFrame, tampered: Column, altered: Column, fields: Sequence[str] = FIELDS, id_col: str = "doc_id",
          text_col: str = "text", group_col: str = "lang", deep: int = LEVELS) -> DataFrame:
    """The manifest of ``docs``, where whoever holds a row with ``tampered`` true
    has ``altered`` for its text: doc_id, leaf, subroot, root, proof_sha256,
    folded_root, verified, one row a row.

    Null fields have a digest of their own; rows without a group are a group,
    the first; a null id comes before all ids, and rows with one id stand in the
    order of their leaves; equal rows are leaves of their own; an empty table
    gives no rows; other columns are not read."""
    held = [altered if c == text_col else F.col(c) for c in fields]
    found = leaves(docs, F.when(tampered, digest(*held)), fields, id_col, group_col)
    out = manifest(coordinates(found), deep)
    return out.select(F.col("id").cast("long").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"),
                      F.col("folded").alias("folded_root"), "verified")
