"""Pairs where a ranking overturns the first stage for the better, and runs side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def reversals(merged: DataFrame, names: list[str], bm25: DataFrame, other: DataFrame, qrels: DataFrame, n: int | None = None, gains: DataFrame | None = None, per: str = "query_id") -> DataFrame:
    """Pairs whose predicted winner (column pred) stands below the loser in ``bm25``, above it in ``other``, and is more relevant.

    Axioms are turned so that 1 supports the winner. The rows stand by the query's gain (``gains``: query_id, gain), relevance gained, places below in ``bm25`` and places
    above in ``other``, all descending; ``n`` keeps the first of each ``per``.
    """
    win = F.col("pred") > 0
    pairs = merged.filter("pred <> 0").select("query_id", F.when(win, F.col("doc_id_1")).otherwise(F.col("doc_id_2")).alias("winner_doc"), F.when(win, F.col("doc_id_2")).otherwise(F.col("doc_id_1")).alias("loser_doc"), *[F.when(win, F.col(a)).otherwise(-F.col(a)).alias(a) for a in names])
    for side in ("winner", "loser"):
        for name, run in (("bm25", bm25), ("llm", other)):
            pairs = pairs.join(run.select(F.col("qid").alias("query_id"), F.col("docno").alias(f"{side}_doc"), F.col("rank").alias(f"{name}_{side}")), ["query_id", f"{side}_doc"])
        pairs = pairs.join(qrels.select("query_id", F.col("doc_id").alias(f"{side}_doc"), F.col("relevance").alias(f"rel_{side}")), ["query_id", f"{side}_doc"], "left").fillna(0, [f"rel_{side}"])
    out = pairs.filter("bm25_winner > bm25_loser AND llm_winner < llm_loser AND rel_winner > rel_loser").withColumn("n_supporting", sum(((F.col(a) > 0).cast("int") for a in names[1:]), (F.col(names[0]) > 0).cast("int")))
    if gains is not None:
        out = out.join(gains.select("query_id", F.col("gain").alias("query_gain")), "query_id", "left")
    order = [F.desc(c) for c in (*(["query_gain"] if gains is not None else []), F.col("rel_winner") - F.col("rel_loser"), F.col("bm25_winner") - F.col("bm25_loser"), F.col("llm_loser") - F.col("llm_winner"))]
    order += ["query_id", "winner_doc", "loser_doc"]
    if n is not None:
        out = out.withColumn("_place", F.row_number().over(Window.partitionBy(per).orderBy(*order))).filter(F.col("_place") <= n).drop("_place")
    return out.orderBy(*order)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; every column is text."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def annotated(annotations: DataFrame, found: DataFrame, key: tuple[str, ...] = ("query_id", "winner_doc", "loser_doc"), name: str = "case_id") -> DataFrame:
    """Annotations with the reversals that they speak of. Each must match one; those that don't are named in the error."""
    lost = annotations.join(found.select(*key), list(key), "left_anti").select(name).limit(20).collect()
    if lost:
        raise ValueError(f"annotations that match no reversal: {sorted(r[name] for r in lost)}")
    from verdictlab.operators.pairs import exact_join

    return exact_join(annotations, found.join(annotations.select(*key).distinct(), list(key), "left_semi"), list(key))


def inspection(found: DataFrame, topics: DataFrame, corpus: DataFrame, names: list[str], n: int = 20) -> str:
    """Markdown to read the first ``n`` reversals by: queries, ranks, grades, axioms and both texts. Only these rows come to the driver."""
    first = found.limit(n).withColumn("_i", F.monotonically_increasing_id())
    rows = first.join(topics.select(F.col("qid").alias("query_id"), "query"), "query_id")
    for side in ("winner", "loser"):
        rows = rows.join(corpus.select(F.col("docno").alias(f"{side}_doc"), F.col("text").alias(f"{side}_text")), f"{side}_doc", "left")
    out = ["# Reversals to inspect", ""]
    for k, r in enumerate(sorted(rows.collect(), key=lambda r: r["_i"]), 1):
        backing = ", ".join(f"{a} {r[a]:+d}" for a in names if r[a]) or "none"
        out += [f"## {k}. {r['query_id']}: {r['query']}", "", f"- grades {r['rel_winner']} over {r['rel_loser']}", f"- first-stage ranks {r['bm25_winner']} and {r['bm25_loser']}, reranked {r['llm_winner']} and {r['llm_loser']}", f"- axioms: {backing}", ""]
        for side in ("winner", "loser"):
            out += [f"{side.capitalize()} `{r[f'{side}_doc']}`:", "", *(f"> {line}" for line in (r[f"{side}_text"] or "").splitlines()), ""]
        out += ["Notes:", "", ""]
    return "\n".join(out)


def run_means(runs: dict[str, DataFrame], metrics: tuple[str, ...] = ("ndcg_10", "ap")) -> DataFrame:
    """run, n_queries and the mean of every metric, over per-query metrics by run."""
    long = None
    for name, df in runs.items():
        part = df.withColumn("run", F.lit(name))
        long = part if long is None else long.unionByName(part)
    return long.groupBy("run").agg(F.count("*").alias("n_queries"), *[F.round(F.avg(m), 6).alias(m) for m in metrics])


def by_run(runs: dict[str, DataFrame], metric: str) -> DataFrame:
    """A row a query, a column a run."""
    long = None
    for name, df in runs.items():
        part = df.select("query_id", F.lit(name).alias("run"), metric)
        long = part if long is None else long.unionByName(part)
    return long.groupBy("query_id").pivot("run", sorted(runs)).agg(F.first(metric))
