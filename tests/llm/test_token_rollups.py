import uuid
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer
from tricky import ROWS, tricky

from ignis.llm import queries, token_rollups
from ignis.session import ensure_checkpoint_dir
from ignis.sources import files


def new(spark):
    return token_rollups.Rollup(spark, f"{ensure_checkpoint_dir(spark)}/rollups/{uuid.uuid4().hex}")


def changes(spark, rows):
    return spark.createDataFrame(rows, token_rollups.CHANGES)


def test_signed_batches_and_idempotence(spark):
    r = new(spark)
    assert r.totals().count() == 0
    first = changes(spark, [("insert", 1, "a", "en", "t", 10, 40, None, None), ("insert", 2, "a", None, "t", 5, 9, None, None),
                            ("insert", 3, "b", "en", "t", None, None, None, None)])
    assert r.commit("b1", first) and not r.commit("b1", first)
    second = changes(spark, [("revise", 1, "a", "en", "t", 12, 41, 10, 40), ("delete", 2, "a", None, "t", None, None, 5, 9)])
    # a job that died after its deltas and before its marker: what it left is not read, and is replaced
    token_rollups.deltas(second).write.parquet(f"{r.root}/deltas/batch_id=b2")
    assert {(x.source, x.tokens) for x in r.totals().collect()} == {("a", 10), ("a", 5), ("b", 0)}
    assert r.commit("b2", second)
    assert r.commit("b3", changes(spark, []))
    assert {tuple(x) for x in r.totals().collect()} == {("a", "en", "t", 1, 12, 41), ("b", "en", "t", 1, 0, 0)}
    with pytest.raises(ValueError):
        r.commit("b/4", second)
    with pytest.raises(Exception, match="unknown op"):
        r.commit("b5", changes(spark, [("drop", 1, "a", "en", "t", 1, 1, 1, 1)]))


def insert(spark, i, tokens=1):
    return changes(spark, [("insert", i, "a", "en", "t", tokens, 2 * tokens, None, None)])


def test_two_writers_of_one_batch(spark, monkeypatch):
    """A second writer commits between the first one's look at the marker and its own commit."""
    r, other = new(spark), None
    other = token_rollups.Rollup(spark, r.root)
    deltas, inner = token_rollups.deltas, []
    def late(c):
        if not inner:
            inner.append(None)
            inner.append(other.commit("b1", insert(spark, 1, 10)))
        return deltas(c)
    monkeypatch.setattr(token_rollups, "deltas", late)
    assert not r.commit("b1", insert(spark, 1, 10)) and inner[1]
    assert [tuple(x) for x in r.totals().collect()] == [("a", "en", "t", 1, 10, 20)]
    assert len(files.names(spark, f"{r.root}/deltas")) == 1  # the loser's folder is gone


def test_a_writer_that_dies_leaves_nothing_that_is_read(spark, monkeypatch):
    r = new(spark)
    def dies(*_):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(files, "put_if_absent", dies)
        with pytest.raises(RuntimeError):
            r.commit("b1", insert(spark, 1, 10))
    assert r.totals().count() == 0 and r.commit("b1", insert(spark, 1, 10))
    assert r.totals().first().tokens == 10


def test_compaction_keeps_totals_and_idempotence(spark, monkeypatch):
    monkeypatch.setattr(token_rollups, "COMPACT_AFTER", 3)
    r = new(spark)
    for i in range(10):
        assert r.commit(f"b{i}", insert(spark, i, i))
    assert files.names(spark, f"{r.root}/bases") == ["00000001", "00000002"]
    assert not r.commit("b0", insert(spark, 0, 0)) and not r.commit("b9", insert(spark, 9, 9))
    assert [tuple(x) for x in r.totals().collect()] == [("a", "en", "t", 10, 45, 90)]
    assert len(files.names(spark, f"{r.root}/deltas")) == 6  # those of the first base are folded in and gone
    assert r.compact() and r.compact()
    assert [tuple(x) for x in r.totals().collect()] == [("a", "en", "t", 10, 45, 90)] and not files.names(spark, f"{r.root}/deltas")


def test_query_equals_direct_count(spark, tmp_path):
    tricky(spark).drop("row").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in queries.op3_token_rollup(spark, str(tmp_path)).collect()}
    tok = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    want, seen = Counter(), {}
    for d, t, lang, source, _ in ROWS:
        seen.setdefault(t, []).append((source, lang))
    for t, where in seen.items():
        final = "\n".join(dict.fromkeys((t or "").split("\n")))
        keys = Counter(where)
        assert len(keys) == 1 or t == ROWS[0][1] or t is None  # which copy stays matters only here
        key = where[0]
        want[(*key, "documents")] += 1
        want[(*key, "tokens")] += len(tok.encode(final, add_special_tokens=False).ids)
        want[(*key, "bytes")] += len(final.encode())
    assert sum(r[3] for r in got) == len(seen)
    assert sum(r[4] for r in got) == sum(v for k, v in want.items() if k[2] == "tokens")
    assert sum(r[5] for r in got) == sum(v for k, v in want.items() if k[2] == "bytes")
