"""Tokenisers and text measures as column expressions. The four tokenisers differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of the tokenisers.
WORD = "[a-z0-9]+"
ANSWER = "[a-z0-9]+(?:'[a-z]+)?"
SOFT = "[a-z0-9]+(?:[._+-][a-z0-9]+)*"
SENTENCE_END = r"(?<=[.!?])\s+|[\r\n]+"
#: Fixed value: words that open a question.
QUESTION_WORDS = ("who", "what", "when", "where", "why", "how", "which", "whom", "whose", "is", "are", "do", "does", "can", "could", "should", "would", "will")


def tokens(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def sentences(text: Column) -> Column:
    """Trimmed, non-empty sentences."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: F.btrim(s, F.lit(" \t\n\r\f\x0b"))), lambda s: s != "")


def content_terms(text: Column, stop: tuple[str, ...]) -> Column:
    return F.array_except(F.array_distinct(tokens(text, ANSWER)), F.array(*map(F.lit, stop)))


def coverage(anchors: Column, found: Column) -> Column:
    """The share of ``anchors`` among the tokens ``found``; 0 without anchors."""
    n = F.size(anchors)
    return F.when(n > 0, F.size(F.array_intersect(anchors, found)) / n).otherwise(0.0)


def is_question(query: Column) -> Column:
    first = F.get(tokens(query), F.lit(0))
    return (F.instr(query, "?") > 0) | F.coalesce(first.isin(*QUESTION_WORDS), F.lit(False))


def is_close(a: Column, b: Column, rel: float) -> Column:
    return F.abs(a - b) <= F.lit(rel) * F.greatest(F.abs(a), F.abs(b))


def hash_score(*parts: Column) -> Column:
    """A score in [0, 1): the first eight bytes of the SHA-256 of the parts joined by a zero byte."""
    digest = F.sha2(F.concat_ws("\0", *parts), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def hash_index(n: Column, *parts: Column) -> Column:
    """A number in [0, n) from the first four bytes of the MD5 of the parts joined by '-'."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("-", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long"), n.cast("long"))


def sign(x: Column) -> Column:
    return F.signum(x).cast("int")
