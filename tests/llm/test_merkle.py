import hashlib
import zlib
from collections import Counter

import duckdb
from pyspark.sql import functions as F
from tricky import ROWS, SCHEMA, empty, tricky

from ignis.llm import merkle, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def brute(rows):
    """doc_id, leaf, subroot, root, proof, folded, verified by the rule's letter; rows are (doc_id, text, lang, source, n_chars)."""
    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][i:i + 8]) for i in range(0, len(out[-1]), 8)])
        return out
    def path(tree, at):
        out = []
        for nodes in tree[:-1]:
            run = at // 8 * 8
            out.append((nodes[run:at], nodes[at + 1:run + 8]))
            at //= 8
        return out
    groups = {}
    for d, t, lang, s, n in rows:
        tampered = d is not None and zlib.crc32(str(d).encode()) % 3 == 0 and t is not None
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t) if tampered else t
        groups.setdefault(lang, []).append((d, leaf_of(d, s, lang, n, t), leaf_of(d, s, lang, n, lower)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = levels([x[1] for x in groups[g]])
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for i, g in enumerate(order):
        for at, (d, leaf, claimed) in enumerate(groups[g]):
            steps = path(trees[g], at) + path(top, i)
            folded = claimed
            for a, b in steps:
                folded = h(*a, folded, *b)
            proof = h(*(x for a, b in steps for x in a + b))
            out.append((d, leaf, trees[g][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return Counter(out)


def run(docs, **more):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return merkle.audit(docs, tampered, merkle.lower_ascii(F.col("text")), **more)


def test_tricky_rows_equal_brute_force(spark):
    assert Counter(map(tuple, run(tricky(spark)).collect())) == brute(ROWS)
    assert run(empty(spark)).count() == 0
    one = spark.createDataFrame(ROWS[:1], SCHEMA)
    assert Counter(map(tuple, run(one).collect())) == brute(ROWS[:1])


def mixed():
    """Dense, sparse, negative, far apart, repeated and null ids; many groups; equal rows."""
    rows = [(i, f"Text {i}", "en", "a", i) for i in range(700)]
    rows += [((-1) ** i * 7 ** (i % 18) * (i + 1), f"T{i}", "de", None, None) for i in range(300)]
    rows += [(5, f"Same id {i % 90}", "fr", "b", 1) for i in range(400)]
    rows += [(None, f"No id {i % 70}", "fr", "b", 1) for i in range(300)]
    rows += [(i, "X", f"l{i % 150}", "c", 2) for i in range(400)]
    rows += [(2 ** 63 - 1, "Max", "en", "a", 1), (-2 ** 63, "Min", "en", "a", 1), (3, None, None, None, None), (64, "ONE", "zz", "a", 1)]
    rows += [(63, "n", None, "a", 1), (64, "N", None, "a", 1), (2 ** 53 + 1, "Ä B", None, "a", 1)]
    return rows


def test_several_arrays_and_levels_equal_brute_force(spark):
    docs = spark.createDataFrame(mixed(), SCHEMA).repartition(7)
    assert Counter(map(tuple, run(docs, deep=2).collect())) == brute(mixed())
    assert Counter(map(tuple, run(docs).collect())) == brute(mixed())


def test_places_are_the_sorted_ones(spark):
    docs = spark.createDataFrame(mixed(), SCHEMA).repartition(5)
    got = merkle.coordinates(merkle.leaves(docs)).collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append(r)
    for own in by.values():
        want = sorted(own, key=lambda r: (r.id is not None, r.id or 0, r.leaf, r.pos))
        assert [r.pos for r in want] == list(range(len(own))) and {r.n for r in own} == {len(own)}


def test_hot_id(spark):
    rows = [(9, f"Hot {i % 1500}", "en", "a", 1) for i in range(3000)] + [(i, "x", "en", "a", 1) for i in range(3000)]
    assert Counter(map(tuple, run(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect())) == brute(rows)


def test_sql_equals_brute_force(spark, tmp_path):
    con = duckdb.connect()
    rows = ROWS + mixed()
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "d"))
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    got = con.execute(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({queries.ORACLE['op11_bitmap_merkle']})").fetchall()
    assert Counter(got) == brute(rows)
