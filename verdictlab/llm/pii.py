"""Personal data by fixed patterns and a character-level bidirectional LSTM with CRF transitions, trained in numpy.

The patterns find the plain forms of e-mail addresses, IP addresses, card numbers and phone numbers. The model, trained from labelled spans
(written out by ``examples`` from a seed), knows the plain forms and others that no pattern takes: phone numbers without a plus sign, masked addresses, cards with other separators.
What it finds is only held to what the kind is (``sane``), not to a form. It reads overlapping windows; each is decoded by Viterbi, and the windows' spans are reconciled over the whole text:
spans of a kind that a window's edge cut are joined, and of spans that overlap the set with the greatest total score stays.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

# ---- fixed patterns

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# starting only at the first digit of a run finds the same matches, and takes linear time over long runs
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end, "email"
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns by start, then kind as listed."""
    out = list(_emails(text))
    out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    out += [(*m.span(), "card") for m in _CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


# ---- the model

WINDOW, STRIDE = 96, 48
HIDDEN, EXAMPLES, EPOCHS, BATCH = 24, 4000, 6, 64
TAGS = 1 + 2 * len(KINDS)  # outside, then first and later characters by kind
#: 0 pads; printable ASCII; other white space; other letters; all else.
CLASSES = 99


def classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.full(len(code), 98, np.int64)
    out[(code >= 0xC0) & (code < 0x2000)] = 97
    out[(code <= 32) | (code == 0x85) | (code == 0xA0)] = 96
    plain = (code >= 32) & (code < 127)
    out[plain] = code[plain] - 31
    return out


def examples(n: int = EXAMPLES, seed: int = 9) -> list[tuple[str, list[Span]]]:
    """Labelled windows: invented words around plain and masked personal data, and around numbers that aren't."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda k: "".join(str(int(d)) for d in rng.integers(0, 10, k))
    syllables = ["an", "er", "th", "ou", "re", "tion", "ble", "ing", "le", "que", "sch", "ä", "é", "ió", "ment", "st", "wh", "ha"]
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))
    name = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(3, 9))))

    def card(sep: str) -> str:
        body = pick(["4", "5", "37"])
        body += digits(15 - len(body))
        d = next(body + c for c in "0123456789" if luhn(body + c))
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def personal() -> tuple[str, str]:
        kind = pick(KINDS)
        if kind == "email":
            at, dot = pick([("@", "."), ("@", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", ".")])
            return f"{name()}{pick(['', '.' + name(), digits(2), '.' + digits(2)])}{at}{name()}{pick(['', digits(1)])}{dot}{pick(['com', 'org', 'net', 'example' + dot + 'com'])}", kind
        if kind == "ip":
            sep = pick([".", ".", "[.]", "(.)"])
            return sep.join(str(int(x)) for x in rng.integers(1, 256, 4)), kind
        if kind == "card":
            return card(pick(["", " ", "-", ".", "/", "_"])), kind
        a, b, c = digits(3), digits(3), digits(4)
        return pick([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(2)} {digits(3)} {digits(4)} {digits(3)}", f"00{digits(2)} {a} {b}{c}"]), kind

    def plain() -> str:
        return pick([str(int(rng.integers(1900, 2030))), digits(int(rng.integers(1, 7))), f"{digits(2)}.{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(1)}", f"20{digits(2)}-0{pick('123456789')}-{pick('12')}{pick('0123456789')}", f"password={hashlib.md5(digits(5).encode()).hexdigest()[:18]}", hashlib.sha1(digits(5).encode()).hexdigest(), "AKIA" + "".join(pick("ABCDEFGHIJ0123456789") for _ in range(16)), f"${digits(3)},{digits(3)}", f"{digits(2)}:{digits(2)}", f"at {word()}", f"#{digits(4)}", f"{digits(5)}-{digits(8)}", f"@{word()}"])

    out = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < WINDOW:
            kind = rng.random()
            if kind < 0.2:
                what, label = personal()
                spans.append((len(text), len(text) + len(what), label))
            elif kind < 0.4:
                what = plain()
            else:
                what = word() + pick(["", "", "", "", ",", ".", ".\n"])
                what = what.capitalize() if rng.random() < 0.1 else what
            text += what + (pick(["", "", "", "", "", ".", ",", ")", "$$$", "!!"]) if kind < 0.4 else "") + " "
        at = int(rng.integers(0, 12))
        out.append((text[at : at + WINDOW], [(max(0, s - at), min(WINDOW, e - at), k) for s, e, k in spans if e > at and s < at + WINDOW]))
    return out


def tags_of(n: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(n, np.int64)
    for s, e, kind in spans:
        k = 1 + 2 * KINDS.index(kind)
        tags[s:e] = k + 1
        tags[s] = k
    return tags


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, table: np.ndarray, u: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states (rows, steps, HIDDEN) over class numbers (rows, steps), and what the gradient needs."""
    n, steps = x.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out, kept = np.empty((n, steps, HIDDEN), np.float32), []
    for t in range(steps):
        z = table[x[:, t]] + h @ u
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        before, c = (h, c), f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[:, t] = h
        if keep:
            kept.append((before, i, f, o, g, tc))
    return out, kept


def _lstm_gradient(x: np.ndarray, u: np.ndarray, kept: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dtable, du = np.zeros((CLASSES, 4 * HIDDEN), np.float32), np.zeros_like(u)
    dh = dc = np.zeros((len(x), HIDDEN), np.float32)
    for t in reversed(range(x.shape[1])):
        (h0, c0), i, f, o, g, tc = kept[t]
        dh = dh + dout[:, t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        np.add.at(dtable, x[:, t], dz)
        du += h0.T @ dz
        dh, dc = dz @ u.T, dc * f
    return dtable, du


def _emissions(p: dict, x: np.ndarray, keep: bool = False):
    ahead, a = _lstm(x, p["ta"], p["ua"], keep)
    back, b = _lstm(x[:, ::-1], p["tb"], p["ub"], keep)
    both = np.concatenate([ahead, back[:, ::-1]], axis=2)
    return both @ p["w"] + p["b"], both, a, b


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _loss(p: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """The negative log-likelihood of the tags under the CRF, and its gradient."""
    e, both, ka, kb = _emissions(p, x, keep=True)
    n, steps, k = e.shape
    tr = p["tr"]
    alpha = np.empty((steps, n, k), np.float32)
    beta = np.zeros((steps, n, k), np.float32)
    alpha[0] = e[:, 0]
    for t in range(1, steps):
        alpha[t] = e[:, t] + _log_sum(alpha[t - 1][:, :, None] + tr, 1)
    for t in reversed(range(steps - 1)):
        beta[t] = _log_sum(tr + (e[:, t + 1] + beta[t + 1])[:, None, :], 2)
    z = _log_sum(alpha[-1], 1)
    rows = np.arange(n)
    gold = sum(e[rows, t, y[:, t]] for t in range(steps)) + sum(tr[y[:, t - 1], y[:, t]] for t in range(1, steps))
    de = np.exp(alpha + beta - z[None, :, None]).transpose(1, 0, 2)
    dtr = np.zeros_like(tr)
    for t in range(1, steps):
        dtr += np.exp(alpha[t - 1][:, :, None] + tr + (e[:, t] + beta[t])[:, None, :] - z[:, None, None]).sum(axis=0)
        np.add.at(dtr, (y[:, t - 1], y[:, t]), -1)
        de[rows, t, y[:, t]] -= 1
    de[rows, 0, y[:, 0]] -= 1
    de, dtr = de / n, dtr / n
    dboth = de @ p["w"].T
    g = {"w": np.einsum("nth,ntk->hk", both, de), "b": de.sum(axis=(0, 1)), "tr": dtr}
    g["ta"], g["ua"] = _lstm_gradient(x, p["ua"], ka, dboth[:, :, :HIDDEN])
    g["tb"], g["ub"] = _lstm_gradient(x[:, ::-1], p["ub"], kb, dboth[:, ::-1, HIDDEN:])
    return float((z - gold).mean()), g


@cache
def trained(n: int = EXAMPLES, epochs: int = EPOCHS, seed: int = 9) -> dict:
    """The model's parameters, by Adam from a seed; kept for the process."""
    rng = np.random.default_rng(seed)
    make = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
    p = {"ta": make(CLASSES, 4 * HIDDEN), "ua": make(HIDDEN, 4 * HIDDEN), "tb": make(CLASSES, 4 * HIDDEN), "ub": make(HIDDEN, 4 * HIDDEN), "w": make(2 * HIDDEN, TAGS), "b": np.zeros(TAGS, np.float32), "tr": make(TAGS, TAGS)}
    data = examples(n, seed)
    x, y = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), np.int64)
    for i, (text, spans) in enumerate(data):
        x[i, : len(text)], y[i, : len(text)] = classes(text), tags_of(len(text), spans)
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    total = epochs * -(-n // BATCH)
    for _ in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, BATCH):
            at = order[i : i + BATCH]
            _, g = _loss(p, x[at], y[at])
            step += 1
            size = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            rate = 0.02 * (1 - 0.9 * step / total)
            for k in p:
                a = g[k] * min(1.0, 5.0 / max(size, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def viterbi(e: np.ndarray, tr: np.ndarray) -> np.ndarray:
    n, steps, _ = e.shape
    score, back = e[:, 0], np.zeros(e.shape, np.int8)
    for t in range(1, steps):
        paths = score[:, :, None] + tr
        back[:, t] = paths.argmax(axis=1)
        score = paths.max(axis=1) + e[:, t]
    tags = np.zeros((n, steps), np.int64)
    tags[:, -1] = score.argmax(axis=1)
    for t in reversed(range(1, steps)):
        tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
    return tags


_TRIGGER = re.compile(r"[0-9@]|\(at\)|\[at\]")
_AT = re.compile(r"@|\(at\)|\[at\]")
_NUMBER = re.compile("[0-9]+")


def sane(text: str, start: int, end: int, kind: str) -> bool:
    """Whether a span of the model can be of its kind at all: an address has one at sign or its mask between two parts, an IP address is four numbers
    up to 255, a card number has 12 to 19 digits that pass Luhn, a phone number 9 to 15; none begins or ends within a word or number."""
    s = text[start:end]
    if start and text[start - 1].isalnum() and s[0].isalnum() or end < len(text) and text[end].isalnum() and s[-1].isalnum():
        return False
    if kind == "email":
        parts = _AT.split(s)
        return len(parts) == 2 and all(any(c.isalnum() for c in p) for p in parts)
    if kind == "ip":
        parts = _NUMBER.findall(s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    d = _digits(s)
    return 12 <= len(d) <= 19 and luhn(d) if kind == "card" else 9 <= len(d) <= 15


def window_starts(text: str) -> set[int]:
    """The windows that hold a trigger, and their neighbours. A sane span holds a digit, an at sign or its mask, so that it begins in one of these."""
    out: set[int] = set()
    last = max(0, -(-(len(text) - WINDOW) // STRIDE)) * STRIDE
    for m in _TRIGGER.finditer(text):
        k = m.start() // STRIDE
        out.update(min(last, max(0, k + d) * STRIDE) for d in (-2, -1, 0, 1))
    return out


def reconcile(found: list[tuple[int, int, str, float, bool]]) -> list[Span]:
    """Spans of all windows made one set: (start, end, kind, score, cut by the window's edge)."""
    joined: list[list] = []
    for s, e, kind, score, cut in sorted(found):
        for x in reversed(joined):
            if x[2] == kind and s < x[1]:
                if cut or x[4]:  # parts of one span
                    x[1], x[3], x[4] = max(x[1], e), max(x[3], score), cut and x[4]
                elif score > x[3]:
                    x[:] = [s, e, kind, score, cut]
                break
        else:
            joined.append([s, e, kind, score, cut])
    joined.sort(key=lambda x: (x[1], x[0]))
    ends = [x[1] for x in joined]
    best = [(0.0, ())]
    for i, (s, e, kind, score, _) in enumerate(joined):
        j = int(np.searchsorted(ends[:i], s, "right"))
        with_it = best[j][0] + max(score, 1e-6)
        best.append((with_it, (best[j][1], (s, e, kind))) if with_it > best[i][0] else best[i])
    out, node = [], best[-1][1]
    while node:
        node, span = node
        out.append(span)
    return out[::-1]


def _read(p: dict, texts: list[str], where: list[tuple[int, int]], rows: int) -> Iterator[tuple[int, int, int, int, str, float]]:
    """(text, window, first character, end, kind, score) of the model's spans in windows."""
    for i in range(0, len(where), rows):
        part = where[i : i + rows]
        x = np.zeros((len(part), WINDOW), np.int64)
        for r, (k, s) in enumerate(part):
            c = classes(texts[k][s : s + WINDOW])
            x[r, : len(c)] = c
        e = _emissions(p, x)[0]
        tags = viterbi(e, p["tr"])
        for r in np.flatnonzero(tags.any(axis=1)).tolist():
            k, s = part[r]
            n, t = min(WINDOW, len(texts[k]) - s), 0
            while t < n:
                if tag := int(tags[r, t]):
                    kind, first = (tag - 1) // 2, t
                    t += 1
                    while t < n and tags[r, t] == 2 * kind + 2:
                        t += 1
                    yield k, s, first, t, KINDS[kind], float((e[r, np.arange(first, t), tags[r, first:t]] - e[r, first:t, 0]).sum())
                else:
                    t += 1


def model_spans(p: dict, texts: list[str], rows: int = 1024, starts: Callable[[str], set[int]] = window_starts) -> list[list[Span]]:
    """The model's sane spans of each text. Where a window's edge cuts a span, the next window is read too, however far that leads."""
    found: list[list] = [[] for _ in texts]
    seen: set[tuple[int, int]] = set()
    todo = {(k, s) for k, t in enumerate(texts) for s in starts(t)}
    while todo:
        seen |= todo
        further: set[tuple[int, int]] = set()
        for k, s, first, t, kind, score in _read(p, texts, sorted(todo), rows):
            left, right = first == 0 and s > 0, t == WINDOW and s + t < len(texts[k])
            if left:
                further.add((k, s - STRIDE))
            if right:
                further.add((k, s + STRIDE))
            found[k].append((s + first, s + t, kind, score, left or right))
        todo = further - seen
    return [[x for x in reconcile(f) if sane(t, *x)] if f else [] for t, f in zip(texts, found, strict=True)]


def spans_of(p: dict, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(spans of the patterns, all spans) of each text; a span of the model that overlaps one of a pattern goes."""
    out = []
    for text, added in zip(texts, model_spans(p, texts), strict=True):
        base = base_spans(text)
        more = [x for x in added if all(x[1] <= s or x[0] >= e for s, e, _ in base)] if added else []
        out.append((base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))))
    return out


def personal_data(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, the patterns' counts by kind, the SHA-256 of their spans, and all spans as kind:start:end.

    A null text is empty. Equal texts have equal results, repeated rows are each read, an empty table gives no row; other columns are left out.
    Long texts are read whole, window by window, in linear time. The model's few thousand parameters go to the executors with the task.
    """
    ready(docs.sparkSession)
    p = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [([sum(k == kind for *_, k in base) for kind in KINDS], hashlib.sha256(written(base).encode()).hexdigest(), written(every)) for base, every in spans_of(p, [t or "" for t in b.column(1).to_pylist()])]
            counts = [pa.array([r[0][i] for r in rows], pa.int64()) for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; of spans that overlap, the first names the whole."""
    out, at = [], 0
    merged: list[list] = []
    for s, e, kind in spans:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, kind])
    for s, e, kind in merged:
        out += [text[at:s], f"<{kind}>"]
        at = e
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the personal data of ``text_col`` replaced; a null text stays null, n_chars (where there is one) follows the text."""
    ready(docs.sparkSession)
    p, at = trained(), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            new = [None if t is None else redact(t, every) for t, (_, every) in zip(texts, spans_of(p, [t or "" for t in texts]), strict=True)]
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
