import hashlib
import random
import re

import numpy as np
import pytest

from verdictlab.llm import pii

from .fixtures import ODD_ROWS, SCHEMA, TEXTS, documents

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in re.findall("[0-9]+", m[0])), "card": 12 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((*m.span(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_patterns_equal_brute_force():
    rng, letters = random.Random(4), "0123456789012345678900..--  @@+()ab%é"
    for _ in range(6000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 50)))
        assert pii.base_spans(text) == brute_base(text), repr(text)
    for text in ["4524 1322 6465 2876 and 4111-1111-1111-1111", "a.b+c@d-e.f.g@h.i 1.2.3.4.5.6.7.8 300.1.1.1", "+1 (389) 555-5010 +44 20 7946 0958."]:
        assert pii.base_spans(text) == brute_base(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "1." * 150_000, "a" * 300_000 + "@", "a@" * 100_000, "+1 " * 100_000):
        pii.base_spans(text)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


@pytest.fixture(scope="module")
def model():
    return pii.trained()


def test_gradient():
    rng = np.random.default_rng(1)
    p = {k: (rng.standard_normal(a.shape) * 0.3).astype(np.float64) for k, a in pii.trained(20, 1).items()}
    x, y = rng.integers(0, pii.CLASSES, (3, 9)), rng.integers(0, pii.TAGS, (3, 9))
    _, g = pii._loss(p, x, y)
    for k, at in (("w", (3, 2)), ("tr", (1, 2)), ("ua", (2, 5)), ("ub", (0, 60)), ("b", (4,)), ("ta", (x[0, 3], 7)), ("tb", (x[1, 2], 40))):
        ends = []
        for d in (1e-2, -1e-2):
            q = {n: a.copy() for n, a in p.items()}
            q[k][at] += d
            ends.append(pii._loss(q, x, y)[0])
        assert (ends[0] - ends[1]) / 2e-2 == pytest.approx(float(g[k][at]), rel=0.08, abs=3e-3)


def test_viterbi_equals_brute_force():
    from itertools import product

    rng = np.random.default_rng(2)
    e, tr = rng.standard_normal((4, 4, 3)), rng.standard_normal((3, 3))
    for row, tags in zip(e, pii.viterbi(e, tr), strict=True):
        score = lambda path, row=row: sum(row[t, k] for t, k in enumerate(path)) + sum(tr[a, b] for a, b in zip(path, path[1:], strict=False))
        assert tuple(tags) == max(product(range(3), repeat=4), key=score)


def strict(found):
    """Correct, missed and wrong spans over (expected, found) of held-out windows, without those that a window's edge cuts."""
    inner = lambda xs: {s for s in xs if s[0] > 0 and s[1] < pii.WINDOW}
    pairs = [(inner(a), inner(b)) for a, b in found]
    return sum(len(a & b) for a, b in pairs), sum(len(a - b) for a, b in pairs), sum(len(b - a) for a, b in pairs)


def test_held_out_spans(model, monkeypatch):
    data = pii.examples(600, seed=1234)
    texts, spans = [t for t, _ in data], [s for _, s in data]
    hit, miss, wrong = strict(zip(spans, pii.model_spans(model, texts), strict=True))
    assert hit / (hit + wrong) > 0.95 and hit / (hit + miss) > 0.95, (hit, miss, wrong)
    # the model alone, nothing of what it finds being checked
    monkeypatch.setattr(pii, "sane", lambda *a: True)
    hit, miss, wrong = strict(zip(spans, pii.model_spans(model, texts), strict=True))
    assert hit / (hit + wrong) > 0.9 and hit / (hit + miss) > 0.95, (hit, miss, wrong)


def test_model_alone_on_documents(model):
    """The spans of the patterns in the documents, none of which the model was trained on, are a second held-out set."""
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()]
    got = pii.model_spans(model, texts)
    base = [pii.base_spans(t) for t in texts]
    hit = sum(len(set(a) & set(b)) for a, b in zip(base, got, strict=True))
    assert hit >= 0.9 * sum(map(len, base)) and sum(len(b) for a, b in zip(base, got, strict=True) if not a) <= 0.02 * sum(map(len, base))


def test_windows_without_triggers_need_no_reading(model):
    every = lambda t: set(range(0, max(1, len(t) - pii.WINDOW + pii.STRIDE), pii.STRIDE))
    texts = [" ".join(t for t, _ in pii.examples(6, seed=s)) for s in range(40)]
    texts += ["th ou er " * 40 + "x" * n + "@mail" + "y" * n + ".example.com and " + "an " * 90 for n in (5, 97, 150, 300)]
    texts += ["re st " * 50 + "k" * n + "[at]host[dot]com on " * 2 + "le " * 80 for n in (4, 120)]
    assert pii.model_spans(model, texts) == pii.model_spans(model, texts, starts=every)


def test_windows_are_reconciled():
    a = [(90, 96, "phone", 4.0, True), (90, 110, "phone", 9.0, False)]
    assert pii.reconcile(a) == [(90, 110, "phone")]
    assert pii.reconcile([(0, 60, "email", 5.0, True), (48, 120, "email", 6.0, True)]) == [(0, 120, "email")]
    assert pii.reconcile([(0, 10, "card", 5.0, False), (5, 15, "phone", 7.0, False), (12, 20, "ip", 5.0, False)]) == [(0, 10, "card"), (12, 20, "ip")]


def test_result_does_not_depend_on_place(model):
    s = "call (212) 555-0187 now"
    for pad in (0, 40, 47, 80, 95, 1000):
        text = "th " * pad + s
        assert [text[a:b] for a, b, k in pii.model_spans(model, [text])[0] if k == "phone"] == ["(212) 555-0187"]


def test_personal_data(spark):
    docs = documents(spark, [*TEXTS, "x@y.zz 1.2.3.4", "4524132264652876 +1 (389) 555-5010 " * 50], ODD_ROWS).repartition(2)
    rows = pii.personal_data(docs).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in rows:
        base = brute_base(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[2] == k for x in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base).encode()).hexdigest()
        assert {f"{k}:{s}:{e}" for s, e, k in base} <= set(r["spans"].split(","))
    assert len(rows) == docs.count()
    assert pii.personal_data(spark.createDataFrame([], SCHEMA)).count() == 0


def test_redaction(spark):
    docs = documents(spark, ["mail x@y.zz, host 1.2.3.4.", None, "clean text"], ODD_ROWS)
    rows = {r["doc_id"]: r for r in pii.redacted(docs).collect()}
    assert rows[0]["text"] == "mail <email>, host <ip>." and rows[0]["n_chars"] == len(rows[0]["text"])
    assert rows[1]["text"] is None and rows[2]["text"] == "clean text" and pii.redacted(docs).columns == docs.columns
