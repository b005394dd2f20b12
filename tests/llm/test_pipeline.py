import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from conftest import SF001
from test_order_minhash import true_similarity
from test_packing import check_sequences, ids_of
from test_quality_rules import brute as measures
from tricky import ROWS, tricky

import corpus_pipeline
from ignis.llm import packing, quality_qda, quality_rules
from ignis.llm.common import table


def test_stages_keep_columns_and_bear_odd_rows(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (11, 0, 0), (8, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (tricky(spark), tricky(spark).limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).columns[:3] == ["doc_id", "start", "length"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_dedup", "packing"]
    assert len(ROWS) == tricky(spark).count()


def test_run_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF001, "documents").collect()}
    accepted = {r.doc_id for r in quality_qda.classify(table(spark, SF001, "documents"), table(spark, SF001, "labels")).collect() if r.predicted}
    good = []
    for d in sorted(accepted):
        m = measures(docs[d]) | {"one": 1}
        if not any(m[r.left] * r.a > m[r.right] * r.b for r in quality_rules.RULES):
            good.append(d)
    link = {d: d for d in good}
    def root(d):
        while link[d] != d:
            d = link[d]
        return d
    size = {d: len((docs[d]).split()) for d in good}
    first = {d: set(zip(w := docs[d].lower().split(), w[1:], w[2:], w[3:], w[4:])) for d in good}
    for i, a in enumerate(good):
        for b in good[:i]:
            # cheap and certain: too few shared shingles can't align
            if len(first[a] & first[b]) >= 0.3 * max(len(first[a]), 1) and true_similarity(docs[a], docs[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                link[y] = x
    kept = {d for d in good if root(d) == d}
    rows = [tuple(r) for r in corpus_pipeline.run(spark, SF001).collect()]
    assert {r[0] for r in rows} == kept and size
    want = Counter()
    for d in kept:
        ids = [*ids_of(docs[d]), packing.END]
        for s in range(0, len(ids), packing.WINDOW):
            raw = np.array(ids[s:s + packing.WINDOW], dtype="<u4").tobytes()
            want[(d, s, len(raw) // 4, zlib.crc32(raw), len(ids))] += 1
    assert Counter(r[:5] for r in rows) == want
    check_sequences(rows, packing.WINDOW)
    assert public_tokenizers.path("byte_bpe_50k.json")
