import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tricky import ROWS, SCHEMA, empty, prose, tricky

from ignis.llm import order_minhash as om


def words(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def edited(base, seed, edits):
    r, out = random.Random(seed), list(base)
    for _ in range(edits):
        out[r.randrange(len(out))] = "zz" + str(r.randrange(10 ** 6))
    return out


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def sequence(text):
    """Labelled k-mers in the open."""
    w = (text or "").lower().split()
    k = [tuple(w[i:i + om.K]) for i in range(len(w) - om.K + 1)] or ([tuple(w)] if w else [])
    seen = {}
    return [(x, seen.setdefault(x, []).append(0) or len(seen[x])) for x in k]  # labels from 1


def true_similarity(a, b, threshold=0.8):
    """Every occurrence counted, or, where that falls short, each k-mer once."""
    def share(x, y):
        m = lcs(x, y)
        return m / (len(x) + len(y) - m) if x and y else 0.0
    x, y = sequence(a), sequence(b)
    every = share(x, y)
    return every if every >= threshold else share([k for k in x if k[1] == 1], [k for k in y if k[1] == 1])


def one(text):
    return om.kmers(pa.array([text], pa.string()))[0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=40), st.lists(st.integers(0, 39), max_size=5), st.sampled_from([0.5, 0.8]))
def test_alignment_equals_brute_force(base, cuts, threshold):
    other = [w for i, w in enumerate(base) if i not in cuts] or ["x"]
    a, b = " ".join(base), " ".join(other)
    got, want = om.similarity(one(a), one(b), threshold), true_similarity(a, b, threshold)
    assert abs(got - want) < 1e-9 if want >= threshold else got == 0.0


def test_order_matters():
    a = words(1, 100)
    moved = a[50:] + a[:50]
    assert om.similarity(one(" ".join(a)), one(" ".join(moved)), 0.8) == 0.0
    x, y = (om.band_keys(*om.kmers(pa.array([" ".join(t)], pa.string()))[:2]) for t in (a, moved))
    assert (x == y).mean() < 0.4  # only sketches whose k-mers all lie in one half agree


def test_kmers_are_labelled_and_distinct():
    value, size, prints = om.kmers(pa.array(["a b c d e a b c d e a b c d e", None, "A b", "a b", " "], pa.string()))
    assert size.tolist() == [11, 0, 1, 1, 0] and len(set(value[:11])) == 11
    assert prints[1] is None and prints[2] == prints[3] and prints[4] is None


def brute_classes(rows):
    n = len(rows)
    link = list(range(n))
    def root(i):
        while link[i] != i:
            i = link[i]
        return i
    for i in range(n):
        for j in range(i):
            if (rows[i][1] or "").split() and (rows[j][1] or "").split() and true_similarity(rows[i][1], rows[j][1]) >= om.THRESHOLD:
                link[root(i)] = root(j)
    groups = {}
    for i in range(n):
        groups.setdefault(root(i), []).append(rows[i][0])
    return sorted(sorted(map(str, g)) for g in groups.values())


def found_classes(df):
    """Documents by class; a class is told by its id and, where that is null, by its text."""
    groups = {}
    for r in df.collect():
        groups.setdefault((r.class_id, r.class_size, r.text_hash if r.class_id is None or r.class_size == 1 else 0), []).append(r)
    assert all(sum(r.kept for r in g) == len(g) // g[0].class_size for g in groups.values())
    return groups


def test_classes_equal_brute_force(spark):
    rows = []
    for g in range(12):
        base = words(g, 60 + 20 * g)
        rows += [(100 * g + i, " ".join(edited(base, i, (0, 0, 1, 2, 6, 30)[i % 6])), "en", "a", 1) for i in range(9)]
    shared = words(77, 40)
    rows += [(5000 + i, " ".join(shared + words(900 + i, 60)), "en", "a", 1) for i in range(15)]  # a passage that many share
    got = found_classes(om.classes(spark.createDataFrame(rows, SCHEMA).repartition(4)))
    assert sorted(sorted(str(r.doc_id) for r in g) for g in got.values()) == brute_classes(rows)


def test_tricky_rows(spark):
    rows = om.classes(tricky(spark)).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert {by[k][0].class_id for k in (1, 3, 12)} == {1} and [by[k][0].kept for k in (1, 3, 12)] == [True, False, False]
    assert sorted(r.kept for r in by[7]) == [False, True] and {r.class_size for r in by[7]} == {2}
    assert all(by[k][0].class_size == 1 and by[k][0].kept for k in (4, 5, 6, 8, 2))
    assert om.classes(empty(spark)).count() == 0


def test_keep_one(spark):
    docs = tricky(spark)
    kept = om.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == sorted(str(d) for d in (1, 2, 4, 5, 6, None, None, 7, 8, 9, 10, 11))
    assert om.keep_one(empty(spark)).count() == 0


def test_large_near_group_is_one_class_without_all_pairs(spark):
    base = words(5, 150)
    rows = [(i, " ".join(edited(base, i, 1 + i % 2)), "en", "a", 1) for i in range(400)]
    got = om.classes(spark.createDataFrame(rows, SCHEMA).repartition(8))
    assert {r.class_id for r in got.collect()} == {0}
    assert got.where("kept").count() == 1


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in om.components(edges).collect()}
    assert set(got[i] for i in range(41)) == {0} and got[101] == got[100] == 100


def test_recall_of_bands_at_the_threshold():
    hits = total = 0
    for seed in range(60):
        base = words(seed, 200)
        other = edited(base, seed, 4)
        a, b = " ".join(base), " ".join(other)
        if om.similarity(one(a), one(b), 0.8) >= 0.8:
            x, y = (om.band_keys(*om.kmers(pa.array([t], pa.string()))[:2]) for t in (a, b))
            hits, total = hits + bool((x == y).any()), total + 1
    assert total > 20 and hits == total


def test_repeats_may_count_once():
    line = " ".join(words(3, 30))
    other = " ".join(edited(line.split(), 1, 1))
    a, b = one("\n".join([line] * 9 + [" ".join(words(4, 400))])), one("\n".join([line] * 3 + [" ".join(words(4, 400))]))
    assert om.aligned(a, b, 0.8) == 0.0 and om.similarity(a, b, 0.8) == 1.0
    assert om.similarity(one(line), one(other), 0.5) < 0.8


def test_texts_that_link_only_with_repeats_counted_once(spark):
    line, rest, whole = (" ".join(words(seed, n)) for seed, n in ((3, 30), (4, 400), (8, 200)))
    rows = [(1, "\n".join([line] * 9 + [rest])), (2, "\n".join([line] * 3 + [rest])),  # 666 and 486 k-mers
            (3, whole), (4, f"{whole}\n{whole}"), (5, " ".join(words(9, 200)))]
    docs = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], SCHEMA).repartition(3)
    assert {r.doc_id: r.class_id for r in om.classes(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    assert sorted(r.doc_id for r in om.keep_one(docs).collect()) == [1, 3, 5]


def test_tiles_link_texts_with_repeats_counted_once():
    line, rest = " ".join(words(3, 30)), " ".join(words(4, 400))
    value, size, _ = om.kmers(pa.array(["\n".join([line] * n + [rest]) for n in (9, 3, 1)] + [" ".join(words(9, 100))]))
    once, keys = om.all_keys(value, size)
    lists = np.split(value.astype(np.int64), np.cumsum(size)[:-1])
    row, tile = np.arange(4), np.zeros(4, np.int64)
    assert [len(k) for k in keys] == [2 * om.BANDS, 2 * om.BANDS, om.BANDS, om.BANDS]
    found = om._tile_links(row, size, once, row, tile, keys, lists, om.THRESHOLD)
    assert len(found) == 2 and {v for link in found for v in link} == {0, 1, 2}


def test_keep_one_with_clashing_and_map_columns(spark):
    text, other = prose(1, 80), prose(2, 90)
    rows = [(1, text), (1, text), (2, text), (3, other), (None, other), (None, None), (None, None), (4, "")]
    docs = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], SCHEMA).repartition(2)
    for name in ("id", "id__", "hash", "hash__", "kept", "kept__", "n__", "rows", "at", "row", "copies", "salt", "id_"):
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id")))
    docs = docs.withColumn("more", F.create_map(F.lit("k"), F.coalesce("doc_id", F.lit(0)))).withColumn("Row_", F.array("doc_id"))
    kept = om.keep_one(docs)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    got = sorted(kept.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or ""))
    assert [(r.doc_id, r.text) for r in got] == [(1, text), (3, other), (4, ""), (None, None), (None, None)]
    assert got[0].n__ == "n__1" and got[0].more == {"k": 1}


def test_one_of_many_repeated_rows_stays(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(prose(1, 60)).alias("text"))
    assert om.keep_one(docs.unionByName(spark.createDataFrame([(5, prose(2, 60))], "doc_id long, text string"))).count() == 2


def test_star_components_keep_one_hub_a_leaf(spark, monkeypatch):
    r = random.Random(4)
    edges = {(i, r.randrange(30)) for i in range(2000) for _ in range(5)} | {(5000 + i, 4000 + i % 7) for i in range(50)}
    edges = {(a, b) for a, b in edges if a != b}
    handed = []
    whole = om.components
    monkeypatch.setattr(om, "components", lambda e: handed.append(e.count()) or whole(e))
    got = {x.node: x.label for x in om.star_components(spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
    link = {n: n for e in edges for n in e}
    def root(n):
        while link[n] != n:
            n = link[n]
        return n
    for a, b in edges:
        link[root(a)] = root(b)
    assert set(got) == set(link)
    by = {}
    for n, label in got.items():
        by.setdefault(label, set()).add(root(n))
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({root(n) for n in link})
    assert sum(handed) <= 30 * 30  # links between hubs, not one row an edge


def test_links_handed_on_are_few_in_a_large_group(spark, monkeypatch):
    base = words(5, 120)
    rows = [(i, " ".join(edited(base, i, 1 + i % 2)), "en", "a", 1) for i in range(600)]
    handed = []
    whole = om.components
    monkeypatch.setattr(om, "components", lambda e: handed.append(e.count()) or whole(e))
    got = om.classes(spark.createDataFrame(rows, SCHEMA).repartition(8))
    assert got.where("class_id = 0 AND class_size = 600").count() == 600 and sum(handed) <= 2 * len(rows)


def test_places_of_long_texts_do_not_change_keys(monkeypatch):
    texts = pa.array([" ".join(words(i, n)) for i, n in enumerate((3, 5, 6, 40, 300))] + ["a b c d e " * 60], pa.string())
    value, size, _ = om.kmers(texts)
    packed = om.band_keys(value, size)
    monkeypatch.setattr(om, "_PACKED", 10)
    assert (om.band_keys(value, size) == packed).all()
