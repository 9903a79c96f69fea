"""Quality rules by tokeniser fertility, on top of a base rule over words, repeats and lines.

Every whole text is measured with two public vocabularies: a byte-level BPE gives characters per token and the entropy of its tokens,
a BPE with byte fallback gives the share of byte tokens. A text is rejected where a measure leaves the band of its language and script;
as entropy rises with length, its band is that of the texts with as many tokens, by powers of two.
The bands come from exact quantiles, on a grid of 1 / GRID, over all distinct texts of a language and script, so that copies can't squeeze a band and partitions
change nothing: three interquartile ranges beyond the quartiles, which are taken SURE standard errors outwards, as a small group knows them badly.
A band that judges texts of other languages is also never narrower than FLOOR around the median.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import ready, staged, text_or_empty

SYMBOLS = b"#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A band reaches so many interquartile ranges beyond the quartiles; a script's, whose languages differ, at least from median * (1 - FLOOR) to median * (1 + FLOOR).
REACH, FLOOR = 3.0, 0.4
#: The lower quartile of n texts is read at the level 0.25 - SURE * sqrt(0.25 * 0.75 / n) in whole hundredths, the upper one likewise.
SURE = 3.0
#: The band of byte fallback reaches at least so far above the median.
FALLBACK_FLOOR = 0.1
#: A language with fewer distinct texts (of a length, for entropy) uses the band of its script; a script with fewer uses that of all documents, however few these are.
MIN_DOCS = 50
#: Quantiles are exact over measures in whole steps of one by GRID.
GRID = 10_000
#: Without a band of its own language, a text is also rejected with a greater share of byte tokens.
MAX_FALLBACK = 0.5

#: Unicode blocks by script (fixed values of the standard): first and last code points.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF)],
    "cyrillic": [(0x400, 0x52F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "thai": [(0xE00, 0xE7F)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
}
_table: np.ndarray | None = None


def script_of(text: str) -> str:
    """The script of most letters; "none" without letters of a listed script, ties to the first listed."""
    global _table
    if text.isascii():
        return "latin" if any(c.isalpha() for c in text) else "none"
    if _table is None:
        _table = np.zeros(0x110000, np.uint8)
        for k, ranges in enumerate(SCRIPTS.values(), 1):
            for a, b in ranges:
                _table[a : b + 1] = k
    seen = np.bincount(_table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")], minlength=len(SCRIPTS) + 1)[1:]
    return list(SCRIPTS)[int(seen.argmax())] if seen.any() else "none"


def repeated_words(words: list) -> int:
    """Words inside a window of three that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number = dict.fromkeys(words)
    for i, w in enumerate(number):
        number[w] = i
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    k = len(number)
    pair = ids[:-1] * k + ids[1:]
    if k >= 1 << 21:  # the product of three would overflow
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * k + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : i + n - 2] |= again
    return int(covered.sum())


def base_measures(text: str) -> tuple[int, int, int, int, int, list[bytes]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), len(text) - sum(map(text.count, SPACES)), n_symbols, len(lines) - len(set(lines)), repeated_words(words), words


class Pieces:
    """Tokens and byte-fallback tokens of a word under a BPE with byte fallback, memoised (a full memo makes way for a new one)."""

    def __init__(self, path: str, limit: int = 120_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte = {i for i in range(self.model.get_piece_size()) if self.model.IsByte(i)}
        self.known: dict[bytes, complex] = {}
        self.older: dict[bytes, complex] = {}
        self.limit = limit

    def counts(self, texts: list[list[bytes]]) -> list[tuple[int, int]]:
        """(tokens, byte tokens) of each text's words; the words that aren't known go to the library at once."""
        if len(self.known) > self.limit:
            self.older, self.known = self.known, {}
        known, older, is_byte = self.known, self.older, self.byte.__contains__
        new = []
        for w in {w for words in texts for w in words if w not in known}:
            if w in older:
                known[w] = older[w]
            else:
                new.append(w)
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            for w, ids in zip(part, self.model.encode([w.decode("utf-8", "replace") for w in part], num_threads=1), strict=True):
                known[w] = complex(len(ids), sum(map(is_byte, ids)))
        totals = [sum(map(known.__getitem__, words)) for words in texts]
        return [(int(x.real), int(x.imag)) for x in totals]


_pieces: dict[str, Pieces] = {}


def entropy(ids: np.ndarray) -> float:
    """Bits of Shannon entropy of the tokens."""
    n = len(ids)
    if not n:
        return 0.0
    ids = np.sort(ids)
    counts = np.diff(np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True]))))
    return float(math.log2(n) - (counts * np.log2(counts)).sum() / n)


MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lang string, script string, n_tokens long, chars_per_token double, byte_fallback double, token_entropy double, text_key long"


def measure(docs: DataFrame, byte_bpe: str, fallback_bpe: str, carry: str | None = None) -> DataFrame:
    """One row a document with the base measures and those of the vocabularies. ``carry`` names a column to keep beside them."""
    ready(docs.sparkSession)
    names = [f.split()[0] for f in MEASURES.split(", ")]
    types = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
    kinds = [types[f.split()[1]] for f in MEASURES.split(", ")]
    more = [carry] if carry else []
    schema = MEASURES + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(byte_bpe)
        pieces = _pieces[fallback_bpe] if fallback_bpe in _pieces else _pieces.setdefault(fallback_bpe, Pieces(fallback_bpe))
        for b in batches:
            texts = b.column(1).to_pylist()
            base_rows, counted = [], []
            for i in range(0, len(texts), 256):  # words by words take many times the room of the text
                some = [base_measures(t) for t in texts[i : i + 256]]
                counted += pieces.counts([r[-1] for r in some])
                base_rows += [r[:-1] for r in some]
            ids, ends = enc.encode_flat(texts)
            rows = []
            for i, (doc_id, text, lang, key, base, (n_pieces, n_bytes)) in enumerate(zip(b.column(0).to_pylist(), texts, b.column(2).to_pylist(), b.column(3).to_pylist(), base_rows, counted, strict=True)):
                n_words, n_repeat, n = base[0], base[4], int(ends[i + 1] - ends[i])
                failed = n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words
                rows.append((doc_id, *base, failed, lang, script_of(text), n, len(text) / n if n else None, n_bytes / n_pieces if n_pieces else None, entropy(ids[ends[i] : ends[i + 1]]), key))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), *b.columns[4:]], [*names, *more])

    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.xxhash64(text).alias("text_key"), *more).mapInArrow(run, schema)


BANDED = ("chars_per_token", "byte_fallback", "token_entropy")
GROUP = ("lang", "script", "octave")


def octave(n_tokens: Column) -> Column:
    """The power of two that the tokens reach."""
    return F.when(n_tokens > 0, F.floor(F.log2(n_tokens.cast("double")))).otherwise(0).cast("int")


def histogram(measured: DataFrame) -> DataFrame:
    """lang, script, octave (-1 for measures that don't depend on length), measure, v (in steps of the grid), n: how many distinct texts."""
    texts = measured.groupBy("lang", "script", "text_key").agg(F.first("n_tokens").alias("n_tokens"), *[F.first(m).alias(m) for m in BANDED])
    each = [F.struct(F.lit(m).alias("measure"), (octave(F.col("n_tokens")) if m == "token_entropy" else F.lit(-1)).alias("octave"), F.round(F.col(m) * GRID).cast("long").alias("v")) for m in BANDED]
    return texts.select("lang", "script", F.explode(F.array(*each)).alias("x")).select("lang", "script", "x.*").filter("v IS NOT NULL").groupBy(*GROUP, "measure", "v").agg(F.count("*").alias("n"))


def bands(hist: DataFrame, *by: str, floor: float = 0.0, least: int = MIN_DOCS) -> DataFrame:
    """The ends of every measure's band (a column of structs), for each group with ``least`` distinct texts or more.

    The quantiles are exact: a group's counts by steps of the grid are added up before and after the shuffle, and take no more room than the grid has steps.
    """
    keys = [*by, "octave", "measure"]
    levels = F.percentile(F.col("v") / GRID, F.array(*[F.lit(k / 100) for k in range(101)]), F.col("n"))
    out = hist.groupBy(*keys).agg(F.sum("n").alias("total"), levels.alias("q")).filter(F.col("total") >= least)
    down = F.greatest(F.lit(0), F.floor(25 - 100 * SURE * F.sqrt(0.1875 / F.col("total")))).cast("int")
    out = out.select(*keys, F.get("q", down).alias("low"), F.get("q", F.lit(50)).alias("mid"), F.get("q", 100 - down).alias("high"))
    width = REACH * (F.col("high") - F.col("low"))
    fallback = F.col("measure") == "byte_fallback"
    low = F.when(fallback, 0.0).otherwise(F.least(F.col("low") - width, F.col("mid") * (1 - floor)))
    high = F.when(fallback, F.greatest(F.col("high") + width, F.col("mid") + FALLBACK_FLOOR)).otherwise(F.greatest(F.col("high") + width, F.col("mid") * (1 + floor)))
    return out.select(*keys, F.struct(low.alias("low"), high.alias("high")).alias("band"))


#: Band tables of so many rows are sent to all executors; larger ones are joined by their keys.
SENT_ROWS = 20_000


def _small(bands_: DataFrame) -> DataFrame:
    bands_ = staged(bands_, "bands")
    return F.broadcast(bands_) if bands_.count() <= SENT_ROWS else bands_


def fertility_rules(docs: DataFrame, byte_bpe: str, fallback_bpe: str, carry: str | None = None) -> DataFrame:
    """One row a document: the measures, base_failed and kept. ``carry`` names one more column of ``docs`` to keep, by which rows can be told apart.

    A null or empty text has no word and fails the base rule; a null language counts as "und". A measure that a text doesn't have can't reject it.
    A text is judged by the band of its language and script, or else of its script, or else of all documents.
    Repeated rows are each judged, with the same verdict. An empty table gives no row. Columns besides doc_id, text and lang are left out.
    A long text is measured whole; a task holds it and its tokens.
    """
    measured = staged(measure(docs, byte_bpe, fallback_bpe, carry), "fertility")
    hist = staged(histogram(measured), "histogram")
    out = measured.withColumn("octave", octave(F.col("n_tokens")))
    levels = []
    for k, (by, floor, least) in enumerate(((("lang", "script"), 0.0, MIN_DOCS), (("script",), FLOOR, MIN_DOCS), ((), FLOOR, 1))):
        found = _small(bands(hist, *by, floor=floor, least=least))
        columns = {}
        for m in BANDED:
            columns[m], keys = f"band{k}_{m}", [*by, *(["octave"] if m == "token_entropy" else [])]
            some = found.filter(F.col("measure") == m).select(*keys, F.col("band").alias(columns[m]))
            if keys:
                out = out.join(some, keys, "left")
            else:  # one band
                ends = some.first() or ((None, None),)
                out = out.withColumn(columns[m], F.struct(*[F.lit(e).cast("double").alias(n) for e, n in zip(ends[0], ("low", "high"), strict=True)]))
        levels.append(columns)
    inside = F.lit(True)
    for m in BANDED:
        band, own = F.coalesce(*[F.col(c[m]) for c in levels]), F.col(levels[0][m])
        high = F.when(own.isNull(), F.least(band["high"], F.lit(MAX_FALLBACK))).otherwise(band["high"]) if m == "byte_fallback" else band["high"]
        inside = inside & F.coalesce((F.col(m) >= band["low"] - 0.5 / GRID) & (F.col(m) <= high + 0.5 / GRID), F.lit(True))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return out.select(*first, (~F.col("base_failed") & inside).alias("kept"), "lang", "script", "n_tokens", "chars_per_token", "byte_fallback", "token_entropy", *([carry] if carry else []))
