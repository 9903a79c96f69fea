"""Mixing sources to target weights by iterative proportional fitting.

Documents fall in cells by source, language and topic. Raking scales the cells' token weights until the token shares of every source, language and topic
meet their targets; a document is then sampled with the probability that its cell's weight gives, by a hash of its id.
No weight may ask for a probability over one: such weights are held at the most within every step, so that the other cells make up for them.
Targets are given by the caller; an axis without has the tempered shares of the documents themselves.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready, unused

AXES = ("source", "lang", "topic")
#: A target share is in proportion to the tokens to this power: below 1, large strata give way to small ones.
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 0.85}
ROUNDS = 20
#: The expected share of tokens kept, where no stratum is too small for its target.
KEEP = 0.5
#: The driver rakes the cells' totals; a table with more cells is refused, and its strata must be made coarser.
MAX_CELLS = 1_000_000
#: So many cells are sent to all executors.
SENT_CELLS = 100_000
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic_of(text: Column, words: Column) -> Column:
    """A coarse topic by form, where the caller gives no other: markup (symbols for one word in five or more), record (with a digit or an at sign), brief, long or prose."""
    marks = F.coalesce(F.regexp_count(text, F.lit("[#*$%&|<>]")), F.lit(0))
    record = F.coalesce(text.rlike("[0-9@]"), F.lit(False))
    return F.when((marks > 0) & (marks * 5 >= words), "markup").when(record, "record").when(words < 100, "brief").when(words >= 1500, "long").otherwise("prose")


def tempered(tokens: np.ndarray, of: np.ndarray, power: float) -> np.ndarray:
    """Shares of the strata in proportion to their tokens to a power."""
    share = np.bincount(of, tokens) ** power
    return share / share.sum() if share.sum() else share


def rake(tokens: np.ndarray, strata: list[np.ndarray], shares: list[np.ndarray], rounds: int = ROUNDS, most: float = np.inf) -> np.ndarray:
    """Weights of the cells after so many rounds over the axes, none over ``most``; strata number each cell's stratum by axis. A stratum without tokens leaves its cells as they are."""
    weight, total = np.ones(len(tokens)), float(tokens.sum())
    for _ in range(rounds):
        for of, share in zip(strata, shares, strict=True):
            now = np.bincount(of, tokens * weight, minlength=len(share))
            weight = np.minimum(weight * np.where(now > 0, total * share / np.where(now > 0, now, 1), 1.0)[of], most)
    return weight


def uniform(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id alone, or from the text where there is no id."""
    who = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), who)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


Targets = dict[str, dict[str | None, float]]


def _shares(axis: str, names: list[str], tokens: np.ndarray, of: np.ndarray, targets: Targets | None) -> np.ndarray:
    """The target shares of an axis's strata (their names are "=" and the value, or empty for null)."""
    if not targets or axis not in targets:
        return tempered(tokens, of, TEMPER[axis])
    wanted = {"" if k is None else f"={k}": float(v) for k, v in targets[axis].items()}
    if lost := sorted(set(names) - set(wanted)):
        raise ValueError(f"no target for {axis} {[x.removeprefix('=') for x in lost]}")
    share = np.array([wanted[n] for n in names])
    if (share < 0).any() or not share.sum() > 0:
        raise ValueError(f"the targets of {axis} must be positive")
    return share / share.sum()


def mixed(docs: DataFrame, keep: float = KEEP, max_cells: int = MAX_CELLS, targets: Targets | None = None, topic: Callable[[Column, Column], Column] = topic_of) -> tuple[DataFrame, str]:
    """Every row of ``docs`` with its columns and, after a prefix that none of them has (given too): topic, tokens, weight, probability, sampled.

    ``targets`` gives shares of tokens by axis ("source", "lang", "topic") and stratum (None for null); every stratum that occurs needs one, and they are scaled to one.
    ``topic`` makes a text's topic of it and of its number of words. ``keep`` is the expected share of tokens kept; strata too small for their target are kept whole.
    A null source or language is a stratum of its own, as is the empty one; a null or empty text has no token and changes no weight. Long texts count whole.
    Rows with one id share their fate, of rows without those with equal texts. An empty table gives an empty one.
    """
    if not 0 < keep <= 1:
        raise ValueError("keep is over 0 and at most 1")
    if unknown := set(targets or ()) - set(AXES):
        raise ValueError(f"no axes: {sorted(unknown)}")
    spark, x = ready(docs.sparkSession), unused(docs)
    key = [f"{x}source", f"{x}lang", f"{x}topic"]
    stratum = {f"{x}{c}": F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in AXES[:2]}
    marked = docs.withColumn(f"{x}tokens", n_words(F.col("text"))).withColumn(f"{x}topic", topic(F.col("text"), F.col(f"{x}tokens"))).withColumns(stratum)
    marked = marked.withColumn(f"{x}topic", F.coalesce(f"{x}topic", F.lit("")))
    cells = marked.groupBy(*key).agg(F.sum(f"{x}tokens").alias("tokens"))
    rows = [tuple(r) for r in cells.limit(max_cells + 1).collect()]
    if len(rows) > max_cells:
        raise ValueError(f"more than {max_cells} cells of source, language and topic; make the strata coarser or raise max_cells")
    rows.sort()
    tokens, strata, shares = np.array([r[3] for r in rows], float), [], []
    for i, axis in enumerate(AXES):
        names, of = np.unique([r[i] for r in rows], return_inverse=True) if rows else (np.zeros(0, str), np.zeros(0, int))
        named = [f"={n}" if axis == "topic" and n else n for n in names.tolist()]
        strata.append(of)
        shares.append(_shares(axis, named, tokens, of, targets))
    weights = rake(tokens, strata, shares, most=1 / keep)
    table = spark.createDataFrame([(*r[:3], float(w)) for r, w in zip(rows, weights, strict=True)], ", ".join(f"{k} string" for k in key) + f", {x}weight double")
    # a row a cell: at most max_cells, and beyond some 100,000 no longer broadcast
    joined = marked.join(F.broadcast(table) if len(rows) <= SENT_CELLS else table, key).withColumn(f"{x}probability", F.least(F.lit(1.0), F.col(f"{x}weight") * keep))
    joined = joined.withColumn(f"{x}sampled", uniform(F.col("doc_id"), F.col("text")) < F.col(f"{x}probability"))
    return joined.select(*docs.columns, *(f"{x}{c}" for c in ("topic", "tokens", "weight", "probability", "sampled"))), x


def raked_mixture(docs: DataFrame, keep: float = KEEP, targets: Targets | None = None) -> DataFrame:
    """One row a document: doc_id, source, lang, topic, tokens, weight, probability, sampled."""
    out, x = mixed(docs.select("doc_id", "text", "source", "lang"), keep, targets=targets)
    return out.select("doc_id", "source", "lang", F.col(f"{x}topic").alias("topic"), F.col(f"{x}tokens").alias("tokens"), F.round(f"{x}weight", 6).alias("weight"), F.round(f"{x}probability", 6).alias("probability"), F.col(f"{x}sampled").alias("sampled"))


def sampled(docs: DataFrame, keep: float = KEEP, targets: Targets | None = None) -> DataFrame:
    """The sampled rows, with the columns of ``docs``."""
    out, x = mixed(docs, keep, targets=targets)
    return out.filter(f"{x}sampled").select(*docs.columns)


def sql(documents: str = "documents", keep: float = KEEP, rounds: int = ROUNDS) -> str:
    """The same in DuckDB's SQL, a level for each axis of each round."""
    word = WORD.replace("\\x20", " ").replace("\\x09", "\t").replace("\\x0D", "\r")
    axes = [f"x_{c}" for c in AXES]
    levels = [
        f"m0 AS (SELECT doc_id, coalesce(text, '') AS text, source, lang, coalesce('=' || source, '') AS x_source, coalesce('=' || lang, '') AS x_lang, CAST(coalesce(len(regexp_extract_all(text, '{word}')), 0) AS BIGINT) AS tokens, coalesce(len(regexp_extract_all(text, '[#*$%&|<>]')), 0) AS marks, coalesce(regexp_matches(text, '[0-9@]'), false) AS record FROM {documents})",
        "m AS (SELECT *, CASE WHEN marks > 0 AND marks * 5 >= tokens THEN 'markup' WHEN record THEN 'record' WHEN tokens < 100 THEN 'brief' WHEN tokens >= 1500 THEN 'long' ELSE 'prose' END AS x_topic FROM m0)",
        "c AS (SELECT x_source, x_lang, x_topic, CAST(sum(tokens) AS DOUBLE) AS t FROM m GROUP BY ALL)",
    ]
    for x, name in zip(axes, AXES, strict=True):
        levels.append(f"s_{name} AS (SELECT {x}, power(sum(t), {TEMPER[name]}) AS p FROM c GROUP BY {x})")
        levels.append(f"t_{name} AS (SELECT {x}, (SELECT sum(t) FROM c) * p / (SELECT nullif(sum(p), 0) FROM s_{name}) AS g_{name} FROM s_{name})")
    levels.append("w0 AS (SELECT c.*, " + ", ".join(f"g_{n}" for n in AXES) + ", CAST(1 AS DOUBLE) AS w FROM c " + " ".join(f"JOIN t_{n} USING ({x})" for x, n in zip(axes, AXES, strict=True)) + ")")
    k = 0
    for _ in range(rounds):
        for x, name in zip(axes, AXES, strict=True):
            levels.append(f"w{k + 1} AS (SELECT x_source, x_lang, x_topic, t, {', '.join(f'g_{n}' for n in AXES)}, least({1 / keep}, w * CASE WHEN sum(t * w) OVER (PARTITION BY {x}) > 0 THEN g_{name} / sum(t * w) OVER (PARTITION BY {x}) ELSE 1 END) AS w FROM w{k})")
            k += 1
    uniform_ = f"CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(text))), 1, 13) AS BIGINT) / {float(2**52)}"
    return f"WITH {', '.join(levels)} SELECT doc_id, source, lang, x_topic AS topic, tokens, round(w, 6) AS weight, round(least(1.0, w * {keep}), 6) AS probability, {uniform_} < least(1.0, w * {keep}) AS sampled FROM m JOIN w{k} USING (x_source, x_lang, x_topic)"
