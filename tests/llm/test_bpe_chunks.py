import hashlib
import re

import public_tokenizers as P
from conftest import SF01
from hypothesis import given, settings
from hypothesis import strategies as st
from tricky import ROWS, empty, prose, tricky

from ignis.llm import bpe_chunks as bc
from ignis.llm import queries

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def direct(text):
    return bc.encoding(RANKS, P.PATTERN).encode_ordinary(text or "")


def in_pieces(text, chunk, overlap):
    starts = list(range(0, max(len(text), 1), chunk))
    pieces = [text[s: s + chunk + overlap] for s in starts]
    ends = [[s + e for e in bc.boundaries(p, P.PATTERN)] for s, p in zip(starts, pieces)]
    return bc.stitch(starts, pieces, ends, P.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab12.'sl \n\t é　", max_size=200), st.integers(5, 40), st.integers(5, 30))
def test_stitched_segments_encode_as_the_whole(text, chunk, overlap):
    segments = in_pieces(text, chunk, overlap)
    assert "".join(segments) == text
    assert [i for s in segments for i in direct(s)] == direct(text)


def test_no_shared_boundary_goes_on_with_the_scan():
    for text in ("a" * 500, " " * 300 + "x" + "\n" * 300, "ab " * 200 + "c" * 400 + " d" * 100):
        assert [i for s in in_pieces(text, 50, 20) for i in direct(s)] == direct(text)


def test_stitching_scans_no_text_often(monkeypatch):
    for text in ("a" * 40_000, "a" * 15_000 + " b" * 500 + "c" * 15_000):
        starts = list(range(0, len(text), 100))
        pieces = [text[s: s + 150] for s in starts]
        ends = [[s + e for e in bc.boundaries(p, P.PATTERN)] for s, p in zip(starts, pieces)]
        seen, whole = [], bc.boundaries
        monkeypatch.setattr(bc, "boundaries", lambda t, p: seen.append(len(t)) or whole(t, p))
        assert "".join(bc.stitch(starts, pieces, ends, P.PATTERN)) == text and sum(seen) < 4 * len(text)
        monkeypatch.setattr(bc, "boundaries", whole)


def test_prose_is_cut():
    assert len(in_pieces(prose(1, 2000), 1000, 100)) >= 8


def test_tricky_rows(spark):
    encoded = bc.encode(tricky(spark), RANKS, P.PATTERN, chunk=1000, overlap=100)
    rows = bc.decode(encoded, RANKS).collect()
    got = sorted((str(r.doc_id), r.ids, bytes(r.bytes)) for r in rows)
    assert got == sorted((str(d), direct(t), (t or "").encode()) for d, t, *_ in ROWS)
    assert bc.encode(empty(spark), RANKS, P.PATTERN).count() == 0


def test_query_digests(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    rows = queries.op8_overlapping_chunks(spark, SF01).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = direct(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
        assert re.fullmatch("[0-9a-f]{64}", r.ids_sha256)
