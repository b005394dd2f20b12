import re
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tricky import ROWS, empty, tricky

from ignis.llm import quality_rules as qr


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= {i, i + 1, i + 2}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
            "n_upper": len(re.findall("[A-Z]", text)), "n_letters": len(re.findall("[A-Za-z]", text))}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t#A　é", max_size=60)), max_size=6))
def test_measures_equal_brute_force(texts):
    got = qr.measure(pa.array(texts, pa.string()))
    assert [{m: int(got[m][i]) for m in qr.MEASURES} for i in range(len(texts))] == [brute(t) for t in texts]


def test_ledger_of_tricky_rows(spark):
    got = Counter(tuple(r) for r in qr.ledger(tricky(spark)).collect())
    want = Counter()
    for d, t, *_ in ROWS:
        m = brute(t)
        bits = sum(qr.bit(r.name) for r in qr.RULES if (m | {"one": 1})[r.left] * r.a > (m | {"one": 1})[r.right] * r.b)
        want[(d, *(m[k] for k in qr.MEASURES), bits)] += 1
    assert got == want
    assert qr.ledger(empty(spark)).count() == 0


def test_policies_and_ablation(spark):
    ledger = qr.ledger(tricky(spark))
    bits = [r.fail_bits for r in ledger.collect()]
    verdicts = Counter((r.policy, r.kept) for r in qr.apply_policies(ledger).collect())
    for policy in qr.POLICIES:
        assert verdicts[policy, True] == sum(b & qr.mask(policy) == 0 for b in bits)
        m = qr.mask(policy)
        for r in qr.ablate(ledger, policy).collect():
            one = qr.bit(r.rule)
            assert r.kept == sum(b & m == 0 for b in bits)
            assert r.fails == sum(b & m & one != 0 for b in bits)
            assert r.fails_only_this == sum(b & m == one for b in bits)
            assert r.kept_without == sum(b & m & ~one == 0 for b in bits)
    assert qr.ablate(qr.ledger(empty(spark))).count() == 0


def test_keep_has_all_columns(spark):
    docs = tricky(spark)
    kept = qr.keep(docs)
    assert kept.columns == docs.columns
    want = Counter(d for d, t, *_ in ROWS if (m := brute(t))["n_words"] >= 50 and d != 12)
    assert Counter(r.doc_id for r in kept.collect()) == want
