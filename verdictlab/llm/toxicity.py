"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found in a block-max inverted index.

Terms are the runs of letters of a text, in lower case. The vocabulary holds every term of the examples, whatever its label or frequency;
terms that no example has can't bring one nearer and don't count. A term's TF-IDF is multiplied by a supervised weight: terms that go with label 1 weigh more, none weighs less.
Document frequencies count all documents. The index keeps the commonest terms' weights as a matrix with the greatest weight of every block of examples,
the others' as postings. A text's blocks are visited by the bound that these give, until no block can hold a nearer example: the neighbours are exact,
ties going to the lesser document id.

What the votes are calibrated on are scores of examples by the examples of other folds, weights included, so that no example has a part in its own score.
The constants were chosen in the same way, by five folds over the labelled rows of sf0.1 that may be learned from.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready

#: At most so many examples of each label, by a hash of their ids: the bound of the sample that the classifier is fitted on.
MAX_EXAMPLES = 2500
NEIGHBOURS, BLOCK = 25, 64
#: A term counts 1 + chi-squared / CHI times its TF-IDF, with the chi-squared of its going with label 1 among the examples (with Yates' correction).
CHI = 5.0
#: So many of the commonest terms are kept as a matrix, and so many texts are looked up together.
DENSE, TOGETHER = 2048, 256
#: More than single precision can be wrong by in a cosine.
SLACK = 2e-5
#: What the prior weighs against the neighbours' votes.
PRIOR_WEIGHT = 0.1
THRESHOLD = 0.7
FOLDS = 5

_LETTERS = re.compile(r"[^\W\d_]+")
#: Terms in order with what goes with each (counts or weights).
Vector = tuple[np.ndarray, np.ndarray]


def terms_of_word(word: str) -> list[str]:
    """The terms of a piece of text without white space."""
    return _LETTERS.findall(word.lower())


class Words:
    """The distinct words of a batch of texts: ``words``, and for every text in order (text, word, count)."""

    def __init__(self, texts: list[str]):
        cut = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        of = cut.flatten().dictionary_encode()
        self.words: list[str] = of.dictionary.to_pylist()
        n = max(1, len(self.words))
        owner = np.repeat(np.arange(len(texts)), np.diff(cut.offsets.to_numpy().astype(np.int64)))
        key, self.count = np.unique(owner * n + of.indices.to_numpy(), return_counts=True)
        self.text, self.word = key // n, key % n


class Reader:
    """Texts' counts over a vocabulary; what a word gives is kept, until a full table makes way for a new one and its words are taken over as they come again."""

    def __init__(self, vocabulary: list[str], limit: int = 300_000):
        self.vocabulary, self.limit = {t: i for i, t in enumerate(vocabulary)}, limit
        #: The number of a word's only term, -1 for none, and below for a word of several: their place in ``several``.
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.several: list[list[int]] = []

    def _number(self, word: str) -> int:
        ids = [self.vocabulary[t] for t in terms_of_word(word) if t in self.vocabulary]
        if len(ids) > 1:
            self.several.append(ids)
            return -1 - len(self.several)
        return ids[0] if ids else -1

    def counts(self, texts: list[str]) -> list[Vector]:
        """(terms in order, counts) of every text."""
        if len(self.several) > self.limit:
            self.known, self.older, self.several = {}, {}, []
        if len(self.known) > self.limit:
            self.known, self.older = {}, self.known
        found, known, older = Words(texts), self.known, self.older
        codes = list(map(known.get, found.words))
        if None in codes:
            for i in [i for i, c in enumerate(codes) if c is None]:
                code = older.get(found.words[i])
                codes[i] = known[found.words[i]] = self._number(found.words[i]) if code is None else code
        of = np.array(codes, np.int64)[found.word] if codes else np.zeros(0, np.int64)
        n = max(1, len(self.vocabulary))
        one, more = np.flatnonzero(of >= 0), np.flatnonzero(of < -1)
        split = [(t, c, self.several[-2 - k]) for t, c, k in zip(found.text[more].tolist(), found.count[more].tolist(), of[more].tolist(), strict=True)]
        key = np.concatenate([found.text[one] * n + of[one], np.array([t * n + i for t, _, ids in split for i in ids], np.int64)])
        count = np.concatenate([found.count[one], np.array([c for _, c, ids in split for _ in ids], np.int64)])
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        count = np.add.reduceat(count, first) if len(first) else count
        key = key[first]
        cuts = np.searchsorted(key, np.arange(len(texts) + 1) * n)
        term, count = (key % n).astype(np.int32), count.astype(np.int32)
        return [(term[a:b], count[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def weighed(ids: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> Vector:
    """(terms in order, weights of length one)."""
    w = (1 + np.log(counts.astype(float))) * idf[ids]
    norm = math.sqrt(float((w * w).sum()))
    return ids, w / norm if norm else w


class Index:
    """Exact nearest examples by cosine.

    The scores of the rarer terms come first, by their postings; a block's bound is the greatest of these and the greatest weights of the common terms.
    The blocks with the greatest bounds are scored until there are enough neighbours, then those that can still hold a nearer example.
    These scores are of single precision: whatever they can't tell from the last neighbour is scored anew in double.
    """

    FIRST = 3

    def __init__(self, vectors: list[Vector], n_terms: int, block: int = BLOCK):
        ids = np.concatenate([v[0] for v in vectors]).astype(np.int32) if vectors else np.zeros(0, np.int32)
        weights = np.concatenate([v[1] for v in vectors]) if vectors else np.zeros(0)
        ends = np.cumsum([0, *[len(v[0]) for v in vectors]])
        self.n_terms, self.block = n_terms, block
        order = self._alike(ids, weights, ends)
        if len(order):
            at = np.concatenate([np.arange(ends[d], ends[d + 1]) for d in order])
            ids, weights, ends = ids[at], weights[at], np.cumsum([0, *np.diff(ends)[order]])
        self.__setstate__((ids, weights, ends, n_terms, block, order))

    def _common(self, ids: np.ndarray, weights: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(column of each of the commonest terms, -1 of the others; the examples' weights of the common terms)."""
        docs = np.repeat(np.arange(len(ends) - 1, dtype=np.int32), np.diff(ends))
        common = np.argsort(-np.bincount(ids, minlength=self.n_terms), kind="stable")[:DENSE]
        column = np.full(self.n_terms, -1, np.int32)
        column[common] = np.arange(len(common))
        at = column[ids]
        matrix = np.zeros((len(ends) - 1, len(common)), np.float32)
        matrix[docs[at >= 0], at[at >= 0]] = weights[at >= 0]
        return column, matrix

    def _alike(self, ids: np.ndarray, weights: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The examples in an order that puts like ones into one block: by the nearest of some centres, and how near it is. Any order gives the same neighbours."""
        n = len(ends) - 1
        k = n // (2 * self.block)
        if k < 2:
            return np.arange(n)
        matrix = self._common(ids, weights, ends)[1]
        centres = matrix[np.arange(k) * n // k]
        for _ in range(6):
            near = matrix @ (centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)).T
            of = near.argmax(axis=1)
            centres = np.stack([matrix[of == c].sum(axis=0) if (of == c).any() else centres[c] for c in range(k)])
        return np.lexsort((np.arange(n), -near[np.arange(n), of], of))

    def __getstate__(self) -> tuple:
        return self.ids, self.weights, self.ends, self.n_terms, self.block, self.order

    def __setstate__(self, state: tuple) -> None:
        self.ids, self.weights, self.ends, self.n_terms, self.block, self.order = state
        self.n, self.visited = len(self.ends) - 1, 0
        self.place = np.argsort(self.order, kind="stable")  # where an example is
        self.blocks = max(1, -(-self.n // self.block))
        self.column, self.matrix = self._common(self.ids, self.weights, self.ends)
        self.starts = np.arange(self.blocks) * self.block
        self.most = np.maximum.reduceat(self.matrix, self.starts, axis=0).T if self.n else np.zeros((self.matrix.shape[1], 1), np.float32)
        docs = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.ends))
        rare = np.flatnonzero(self.column[self.ids] < 0)
        rare = rare[np.argsort(self.ids[rare], kind="stable")]
        self.post_docs, self.post_weights = docs[rare], self.weights[rare]
        self.post_ends = np.searchsorted(self.ids[rare], np.arange(self.n_terms + 1))

    def nearest(self, ids: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the ``k`` nearest with a cosine over zero, nearest first, then by number."""
        return self.nearest_of_all([(ids, weights)], k, [without])[0]

    def nearest_of_all(self, texts: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of every text."""
        out = []
        for i in range(0, len(texts), TOGETHER):
            out += self._together(texts[i : i + TOGETHER], k, without[i : i + TOGETHER] if without else [-1] * TOGETHER)
        return out

    def _together(self, texts: list[Vector], k: int, without: list[int]) -> list[Vector]:
        if not self.n:
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(texts)
        q = np.repeat(np.arange(len(texts)), [len(t[0]) for t in texts])
        ids, weights = np.concatenate([t[0] for t in texts]), np.concatenate([t[1] for t in texts])
        at = self.column[ids]
        common = np.zeros((len(texts), self.matrix.shape[1]), np.float32)
        common[q[at >= 0], at[at >= 0]] = weights[at >= 0]
        q, t, w = q[at < 0], ids[at < 0], weights[at < 0]
        first, many = self.post_ends[t], self.post_ends[t + 1] - self.post_ends[t]
        here = np.arange(many.sum()) + np.repeat(first - (np.cumsum(many) - many), many)
        rare = np.bincount(np.repeat(q, many) * self.n + self.post_docs[here], np.repeat(w, many) * self.post_weights[here], len(texts) * self.n).astype(np.float32).reshape(len(texts), self.n)
        bound = common @ self.most + np.maximum.reduceat(rare, self.starts, axis=1)
        score = np.full(rare.shape, -1, np.float32)
        left = np.zeros(bound.shape, bool)
        top = np.argsort(-bound, axis=1, kind="stable")[:, : self.FIRST]
        np.put_along_axis(left, top, True, axis=1)
        done = ~(bound > 0)
        floor = np.zeros(len(texts), np.float32)
        for first in (True, False):
            left &= ~done
            self.visited += int(left.sum())
            for b in np.flatnonzero(left.any(axis=0)).tolist():
                rows, span = np.flatnonzero(left[:, b]), slice(b * self.block, (b + 1) * self.block)
                if 2 * len(rows) > len(texts):  # all at once costs less than to pick them out
                    score[rows, span] = (common @ self.matrix[span].T + rare[:, span])[rows]
                else:
                    score[rows, span] = common[rows] @ self.matrix[span].T + rare[rows, span]
            for i, d in enumerate(without[: len(texts)]):
                if d >= 0:
                    score[i, self.place[d]] = -1
            done |= left
            if first:  # what the last neighbour has at least
                at = (top[:, :, None] * self.block + np.arange(self.block)).reshape(len(texts), -1)
                seen = np.where(at < self.n, np.take_along_axis(score, np.minimum(at, self.n - 1), axis=1), -1)
                if seen.shape[1] >= k:
                    floor = np.maximum(-np.partition(-seen, k - 1, axis=1)[:, k - 1], 0)
                left = bound >= floor[:, None] - SLACK
        found, whole = [], np.zeros(self.n_terms)
        for i, (ids, weights) in enumerate(texts):
            near = np.flatnonzero((score[i] > 0) & (score[i] >= floor[i] - SLACK))
            if len(near) > k:
                mine = score[i, near]
                near = near[mine >= -np.partition(-mine, k - 1)[k - 1] - SLACK]
            many = self.ends[near + 1] - self.ends[near]
            stops = np.cumsum(many)
            here = np.arange(many.sum()) + np.repeat(self.ends[near] - (stops - many), many)
            whole[ids] = weights
            x = np.round(np.add.reduceat(whole[self.ids[here]] * self.weights[here], stops - many), 9) if len(near) else np.zeros(0)
            whole[ids] = 0
            near, x = self.order[near[x > 0]], x[x > 0]
            order = np.lexsort((near, -x))[:k]
            found.append((near[order], x[order]))
        return found


def emphasis(labels: np.ndarray, counts: list[Vector], n_terms: int, chi: float = CHI) -> np.ndarray:
    """What every term's TF-IDF is multiplied by: one, and more for terms that go with label 1."""
    n, toxic = np.zeros(n_terms), np.zeros(n_terms)
    for y, (ids, _) in zip(labels.tolist(), counts, strict=True):
        n[ids] += 1
        toxic[ids] += y
    m = float(len(labels))
    m1 = float(labels.sum())
    off = np.maximum(np.abs(toxic * m - n * m1) - m / 2, 0)
    squared = m * off * off / np.maximum(m1 * (m - m1) * n * (m - n), 1)
    return 1 + np.where(toxic * m > n * m1, squared, 0) / chi


class Voters:
    """Examples with their labels, what each stands for, and the index over their weighted vectors."""

    def __init__(self, labels: np.ndarray, counts: list[Vector], idf: np.ndarray, true_counts: tuple[int, int], chi: float = CHI):
        self.labels = labels.astype(float)
        n1 = max(1.0, float(self.labels.sum()))
        n0 = max(1.0, float(len(labels) - self.labels.sum()))
        self.weight = np.where(self.labels > 0, true_counts[1] / n1, true_counts[0] / n0)
        self.scale = float(self.weight.mean()) if len(labels) else 1.0
        self.prior = (true_counts[1] + 0.5) / (sum(true_counts) + 1)
        self.idf = idf * emphasis(self.labels, counts, len(idf), chi)
        self.index = Index([weighed(*c, self.idf) for c in counts], len(idf))

    def votes(self, counts: list[Vector]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """(log odds of label 1, nearest examples, cosines) of texts: neighbours vote by the square of their cosine and by what they stand for."""
        out = []
        for d, x in self.index.nearest_of_all([weighed(*c, self.idf) for c in counts], NEIGHBOURS):
            w = x * x * self.weight[d] if len(d) else x
            p = (float((w * self.labels[d]).sum()) + PRIOR_WEIGHT * self.scale * self.prior) / (float(w.sum()) + PRIOR_WEIGHT * self.scale)
            out.append((math.log(p / (1 - p)), d, x))
        return out


def crossed(labels: np.ndarray, counts: list[Vector], idf: np.ndarray, true_counts: tuple[int, int], chi: float = CHI) -> np.ndarray:
    """The log odds of every example by the examples of the other folds, dealt by turns."""
    raw, fold = np.zeros(len(labels)), np.arange(len(labels)) % FOLDS
    for f in range(min(FOLDS, len(labels))):
        rest, here = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        voters = Voters(labels[rest], [counts[i] for i in rest], idf, true_counts, chi)
        raw[here] = [v for v, _, _ in voters.votes([counts[i] for i in here])]
    return raw


class Model:
    """The examples, and the logistic curve that makes their votes probabilities."""

    def __init__(self, ids: list[int], labels: np.ndarray, counts: list[Vector], vocabulary: list[str], idf: np.ndarray, true_counts: tuple[int, int]):
        self.ids, self.vocabulary = ids, vocabulary
        self.voters = Voters(labels, counts, idf, true_counts)
        self.a, self.b = 1.0, 0.0
        bare = np.array([len(c[0]) == 0 for c in counts], bool)
        w = self.voters.weight[bare]
        self.bare = float((w * self.voters.labels[bare]).sum() + self.voters.prior) / float(w.sum() + 1) if len(labels) else self.voters.prior
        if not bare.all():
            self._calibrate(crossed(labels, counts, idf, true_counts)[~bare], self.voters.labels[~bare], self.voters.weight[~bare])

    def _calibrate(self, raw: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        """A logistic curve of the examples' own votes, by damped Newton steps with a pull to slope one."""
        x = np.stack([raw, np.ones_like(raw)], axis=1)
        theta, pull, w = np.array([1.0, 0.0]), np.array([1.0, 0.1]), w / w.mean()
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            g = x.T @ (w * (p - y)) + pull * (theta - [1.0, 0.0])
            h = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(pull)
            step = np.linalg.solve(h, g)
            theta = theta - np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-9:
                break
        if theta[0] > 0:
            self.a, self.b = float(theta[0]), float(theta[1])

    def scores(self, counts: list[Vector]) -> list[tuple[float, str]]:
        """(the probability of label 1, the three nearest examples as id:cosine:label) of every text."""
        out = []
        for (ids, _), (vote, d, x) in zip(counts, self.voters.votes(counts), strict=True):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, self.a * vote + self.b)))) if len(ids) else self.bare
            out.append((p, ",".join(f"{self.ids[i]}:{c:.4f}:{int(self.voters.labels[i])}" for i, c in zip(d[:3].tolist(), x[:3].tolist(), strict=True))))
        return out


def held_out(doc_id: Column) -> Column:
    """Whether the CRC-32 of the id as text leaves remainder 1 by three; a null id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 3 == 1


def fit_sample(labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> tuple[dict[int, int], tuple[int, int]]:
    """({doc_id: label} of at most ``max_examples`` a label, the true counts of both labels) over labelled rows that aren't held out.

    A document with several labels counts as toxic if one says so; null ids and labels don't count.
    """
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    sample: dict[int, int] = {}
    for y in (0, 1):
        order = F.md5(F.concat(F.lit("toxic|"), F.col("doc_id").cast("string")))
        sample |= {r["doc_id"]: y for r in known.filter(F.col("toxic") == y).orderBy(order, "doc_id").limit(max_examples).collect()}
    return sample, (counts.get(0, 0), counts.get(1, 0))


def examples(docs: DataFrame, sample: dict[int, int]) -> list[tuple[int, dict[str, int]]]:
    """(id, terms and their counts) of the examples in order of their ids. Of rows that share an id, the one whose terms and counts are the least as text stands for it."""
    if not sample:
        return []
    chosen = docs.sparkSession.createDataFrame([(d,) for d in sample], "doc_id long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            found = Words(texts)
            counts: list[dict[str, int]] = [{} for _ in texts]
            for t, w, n in zip(found.text.tolist(), found.word.tolist(), found.count.tolist(), strict=True):
                for term in terms_of_word(found.words[w]):
                    counts[t][term] = counts[t].get(term, 0) + n
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([" ".join(f"{t} {n}" for t, n in sorted(c.items())) for c in counts], pa.string())], ["doc_id", "terms"])

    # at most two times max_examples ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    out: dict[int, str] = {}
    for r in texts.mapInArrow(run, "doc_id long, terms string").toLocalIterator():
        out[r["doc_id"]] = min(out.get(r["doc_id"], r["terms"]), r["terms"])
    pairs = lambda x: dict(zip(x[::2], map(int, x[1::2]), strict=True))
    return [(d, pairs(out[d].split())) for d in sorted(out)]


def frequencies(docs: DataFrame, shared) -> tuple[int, np.ndarray]:
    """The number of rows, and of those that hold each term of the vocabulary (a broadcast list)."""
    size = len(shared.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, seen, n = _reader(shared.id, shared.value), np.zeros(size, np.int64), 0
        for b in batches:
            found = reader.counts([t or "" for t in b.column(0).to_pylist()])
            n += len(found)
            seen += np.bincount(np.concatenate([ids for ids, _ in found]), minlength=size) if found else 0
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *held.tolist()], pa.int32()), pa.array([n, *seen[held].tolist()], pa.int64())], ["term", "n"])

    rows = docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = (rows.column(c).to_numpy() for c in ("term", "n"))
    out = np.zeros(size, np.int64)
    out[term[term >= 0]] = n[term >= 0]
    return int(n[term < 0].sum()), out


_last: tuple[int, Reader] | None = None


def _reader(name: int, vocabulary: list[str]) -> Reader:
    """One reader a worker process, for the vocabulary it was last asked for."""
    global _last
    if _last is None or _last[0] != name:
        _last = (name, Reader(vocabulary))
    return _last[1]


class _Broadcast:
    """A broadcast with a number by which workers know it."""

    def __init__(self, spark, value):
        self._held = spark.sparkContext.broadcast(value)
        self.id = self._held._jbroadcast.id()

    def __getstate__(self):
        return self._held, self.id

    def __setstate__(self, state):
        self._held, self.id = state

    @property
    def value(self):
        return self._held.value


def fitted(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> Model:
    """The model of the examples. Its size, and that of what is broadcast and collected, follows the examples' texts, not the documents."""
    spark = ready(docs.sparkSession)
    sample, true_counts = fit_sample(labels, max_examples)
    rows = examples(docs, sample)
    vocabulary = sorted({t for _, c in rows for t in c})
    n_docs, df = frequencies(docs, _Broadcast(spark, vocabulary)) if vocabulary else (0, np.zeros(0))
    number, counts = {t: i for i, t in enumerate(vocabulary)}, []
    for _, c in rows:
        found = sorted((number[t], n) for t, n in c.items())
        counts.append((np.array([i for i, _ in found], np.int32), np.array([n for _, n in found], np.int32)))
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    return Model([d for d, _ in rows], np.array([sample[d] for d, _ in rows], float), counts, vocabulary, idf, true_counts)


def toxicity(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted (1 from a score of 0.7 on), evidence.

    Nothing but the text enters a score. A text without any term of the examples (null, empty, or of words that none holds) gets the share of toxic examples among such texts.
    Equal texts have equal scores; repeated rows are each scored; an empty table gives no row, and without labels every score is the prior. Long texts are read whole.
    """
    spark = docs.sparkSession
    shared = _Broadcast(spark, fitted(docs, labels, max_examples))  # the vectors of at most two times max_examples texts, and their terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        reader = _reader(shared.id, m.vocabulary)
        for b in batches:
            found = m.scores(reader.counts([t or "" for t in b.column(1).to_pylist()]))
            p = [x for x, _ in found]
            held = [is_held_out(d) for d in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.bool_()), pa.array(p, pa.float64()), pa.array([int(x >= THRESHOLD) for x in p], pa.int32()), pa.array([why for _, why in found], pa.string())], ["doc_id", "held_out", "score", "predicted", "evidence"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, evidence string")
