import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from conftest import SF01
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tricky import ROWS, empty, tricky

from ignis.llm import packing, queries
from ignis.llm.tokens import encode_slice

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)
TOK.encode_special_tokens = True


def ids_of(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab1.' \n\t\r　 é\x1c\x85<|endoftext|>", max_size=30), min_size=1, max_size=4))
def test_units_equal_the_tokenizer(texts):
    got = encode_slice(pa.array(texts, pa.string()), PATH)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids_of(t) for t in texts]


def check_cover(rows, docs, window):
    rows = [tuple(r) for r in rows]
    want = {}
    for d, t, *_ in docs:
        ids = [*ids_of(t), packing.END]
        raw = np.array(ids, dtype="<u4").tobytes()
        for s in range(0, len(ids), window):
            piece = raw[4 * s: 4 * (s + window)]
            key = (d, s, len(piece) // 4, zlib.crc32(piece), len(ids))
            want[key] = want.get(key, 0) + 1
    got = {}
    for r in rows:
        got[r[:5]] = got.get(r[:5], 0) + 1
    assert got == want
    check_sequences(rows, window)


def check_sequences(rows, window):
    by = {}
    for r in rows:
        by.setdefault(r[5], []).append((r[6], r[2]))
    assert sorted(by) == list(range(len(by)))
    for own in by.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= window


def test_tricky_rows(spark):
    for window in (2048, 64):
        check_cover(packing.pack(tricky(spark), PATH, window).collect(), ROWS, window)
    assert packing.pack(empty(spark), PATH).count() == 0


def test_ids_come_with_the_pieces(spark):
    rows = packing.pack(tricky(spark), PATH, 64, with_ids=True).collect()
    one = sorted((r.start, r.ids) for r in rows if r.doc_id == 2)
    assert [i for _, ids in one for i in ids] == [*ids_of(ROWS[1][1]), packing.END]


def test_little_padding(spark):
    rows = [tuple(r) for r in queries.op6_nnls_packing(spark, SF01).collect()]
    check_sequences(rows, 2048)
    tokens = sum(r[2] for r in rows)
    assert tokens / (2048 * len({r[5] for r in rows})) > 0.99


def test_plan_holds_the_histogram():
    rng = np.random.default_rng(0)
    for n in (0, 1, 50, 200_000):
        lengths = np.minimum(rng.geometric(1 / 600, n), 2048)
        histogram = np.bincount(lengths, minlength=2049)
        plan = packing.plan(histogram)
        back = np.zeros(2049, dtype=np.int64)
        for times, parts in plan.groups:
            assert times > 0 and sum(parts) <= 2048
            for p in parts:
                back[p] += times
        assert (back == histogram).all()
        sequences = sum(t for t, _ in plan.groups)
        if n >= 50_000:
            assert lengths.sum() / (2048 * sequences) > 0.995


def test_fit_is_non_negative_and_close():
    combos = packing.combinations(np.arange(1, 64), 64)
    assert (combos.sum(axis=1) == 64).all()
    truth = np.zeros(len(combos))
    truth[::7] = 30
    histogram = np.bincount(combos.ravel(), weights=np.repeat(truth, 3), minlength=65)
    histogram[0] = 0
    x = packing.repeat_counts(combos, histogram, 2000)
    fit = np.bincount(combos.ravel(), weights=np.repeat(x, 3), minlength=65)
    assert (x >= 0).all() and np.abs(fit - histogram)[1:].max() < 0.05 * histogram.max()


def test_hot_length(spark):
    docs = spark.createDataFrame([(i, "same words here" if i % 3 else "word " * (i % 40), None, None, None) for i in range(3000)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    check_sequences([tuple(r) for r in packing.pack(docs, PATH).collect()], 2048)
