"""Rankings from pair preferences and scores, their evaluation and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdictlab.functions.text import hash_index
from verdictlab.sources.staging import staged


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """qid, docno, rank from 0, score = -rank by an order within the query."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy(*order)) - 1
    return df.select("qid", "docno", place.alias("rank"), (-place).cast("double").alias("score"))


def copeland(verdicts: DataFrame, pool: DataFrame) -> DataFrame:
    """Wins less losses; documents in any pair come first, by score, then first-stage rank; the others keep their order below."""
    one = verdicts.select(F.col("query_id").alias("qid"), F.col("doc_id_1").alias("docno"), F.col("model_pref").alias("won"))
    two = verdicts.select(F.col("query_id").alias("qid"), F.col("doc_id_2").alias("docno"), (-F.col("model_pref")).alias("won"))
    score = one.unionByName(two).groupBy("qid", "docno").agg(F.sum("won").alias("won"))
    return ranked(pool.select("qid", "docno", F.col("rank").alias("first")).join(score, ["qid", "docno"], "left"), F.col("won").isNull(), F.desc("won"), F.col("first"))


def rerank_scored(pool: DataFrame, scores: DataFrame, depth: int, strict: bool = True) -> DataFrame:
    """Documents ranked above ``depth`` by their score (column s), then first-stage rank; the rest in first-stage order.

    With ``strict`` a document above ``depth`` without a score is an error; else it goes to the rest.
    """
    if depth <= 0:
        raise ValueError("depth must be positive")
    joined = pool.select("qid", "docno", F.col("rank").alias("first")).join(scores.select("qid", "docno", "s"), ["qid", "docno"], "left")
    if strict and (lost := joined.filter((F.col("first") < depth) & F.col("s").isNull()).limit(3).collect()):
        raise ValueError(f"documents without a score: {[(r['qid'], r['docno']) for r in lost]}")
    block = (F.col("first") < depth) & F.col("s").isNotNull()
    return ranked(joined.withColumn("block", block), F.desc("block"), F.desc(F.when(F.col("block"), F.col("s"))), F.col("first"))


def oracle_rerank(pool: DataFrame, qrels: DataFrame, depth: int) -> DataFrame:
    """The best order of the first ``depth``: by grade, then first-stage rank."""
    grades = qrels.select(F.col("doc_id").alias("docno"), F.col("query_id").alias("qid"), "relevance")
    joined = pool.select("qid", "docno", F.col("rank").alias("first")).join(grades, ["qid", "docno"], "left")
    return ranked(joined, F.col("first") >= depth, F.desc(F.when(F.col("first") < depth, F.coalesce("relevance", F.lit(0)))), F.col("first"))


def evaluate(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """query_id, ndcg_10 (linear gain), ap of every judged query; a query that the run misses has zeros. Equal scores rank by descending docno."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("docno")))
    got = run.select(F.col("qid").alias("query_id"), F.col("docno").alias("doc_id"), place.alias("place")).join(qrels, ["query_id", "doc_id"]).filter("relevance > 0")
    hits = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    got = got.withColumn("precision", hits / F.col("place"))
    gain = F.when(F.col("place") <= k, F.col("relevance") / F.log2(F.col("place") + 1)).otherwise(0.0)
    sums = got.groupBy("query_id").agg(F.sum(gain).alias("dcg"), F.sum("precision").alias("precision"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id"))
    ideal = qrels.withColumn("best", best).groupBy("query_id").agg(F.sum(F.when((F.col("best") <= k) & (F.col("relevance") > 0), F.col("relevance") / F.log2(F.col("best") + 1)).otherwise(0.0)).alias("ideal"), F.count_if(F.col("relevance") > 0).alias("n_rel"))
    rate = lambda a, b: F.round(F.when(F.col(b) > 0, F.coalesce(a, F.lit(0.0)) / F.col(b)).otherwise(0.0), 6)
    return ideal.join(sums, "query_id", "left").select("query_id", rate("dcg", "ideal").alias("ndcg_10"), rate("precision", "n_rel").alias("ap"))


def draws(spark: SparkSession, n: int, n_bootstrap: int, seed: int = 42) -> DataFrame:
    """draw, slot, times: how often each of ``n`` numbered units is taken in each draw of ``n``, by a seeded hash. Units that a draw leaves out have no row."""
    table = spark.range(n_bootstrap).select(F.col("id").alias("draw")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))))
    return table.select("draw", hash_index(F.lit(n), F.lit(seed), F.col("draw"), F.col("j")).alias("slot")).groupBy("draw", "slot").agg(F.count("*").alias("times"))


def numbered(df: DataFrame, key: str) -> tuple[DataFrame, int]:
    """``df`` (a row a query) with ``slot`` by the order of ``key``, and the number of rows. Queries are few; documents never come here."""
    n = df.count()
    return df.withColumn("slot", F.row_number().over(Window.orderBy(key)).cast("long") - 1), n


def resampled(df: DataFrame, key: str, sums: dict[str, Column], n_bootstrap: int, seed: int) -> DataFrame:
    """A row a draw with each of ``sums``: expressions over ``df`` (a row a query) and ``times``. All of them share one set of draws, so that one join serves all."""
    rows, n = numbered(df, key)
    return draws(df.sparkSession, n, n_bootstrap, seed).join(F.broadcast(rows), "slot").groupBy("draw").agg(*[v.alias(k) for k, v in sums.items()])


def interval(value: Column) -> Column:
    """The 2.5 % and 97.5 % points, as an array."""
    return F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))


#: Resamples of a comparison of runs.
N_BOOTSTRAP = 10_000


def compare_runs(baseline: DataFrame, other: DataFrame, metrics: tuple[str, ...] = ("ndcg_10", "ap"), n_bootstrap: int = N_BOOTSTRAP, seed: int = 42) -> DataFrame:
    """A row a metric: means, mean difference with its 95 % interval over resampled queries, wins, ties and losses. The query sets must be equal."""
    a = baseline.select("query_id", F.lit(1).alias("_a"), *[F.col(m).alias(f"{m}_a") for m in metrics])
    b = other.select("query_id", F.lit(1).alias("_b"), *[F.col(m).alias(f"{m}_b") for m in metrics])
    both = staged(a.join(b, "query_id", "full").withColumns({f"{m}_d": F.round(F.col(f"{m}_b") - F.col(f"{m}_a"), 6) for m in metrics}), "both")
    seen = both.agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("queries"), F.count("_a").alias("a"), F.count("_b").alias("b")).first()
    if len(set(seen)) > 1:
        raise ValueError(f"the runs' queries don't match one to one: {seen['n']} rows, {seen['queries']} queries, {seen['a']} and {seen['b']} of them")
    boot = resampled(both, "query_id", {m: F.sum(F.col(f"{m}_d") * F.col("times")) / F.sum("times") for m in metrics}, n_bootstrap, seed)
    ci = boot.agg(*[interval(F.col(m)).alias(m) for m in metrics])
    long = both.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_a").alias("a"), F.col(f"{m}_b").alias("b"), F.col(f"{m}_d").alias("d")) for m in metrics])).alias("x")).select("x.*")
    means = long.groupBy("metric").agg(F.round(F.avg("a"), 6).alias("mean_baseline"), F.round(F.avg("b"), 6).alias("mean_reranked"), F.round(F.avg("d"), 6).alias("mean_delta"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") == 0).alias("ties"), F.count_if(F.col("d") < 0).alias("losses"), F.count("*").alias("n_queries"))
    ends = ci.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("q")) for m in metrics])).alias("x")).select("x.*")
    return means.join(ends, "metric").select("metric", "mean_baseline", "mean_reranked", "mean_delta", F.round(F.col("q")[0], 6).alias("delta_ci_lo"), F.round(F.col("q")[1], 6).alias("delta_ci_hi"), "wins", "ties", "losses", "n_queries")


def comparison_matrix(runs: dict[str, DataFrame], contrasts: list[tuple[str, str, str]], n_bootstrap: int = N_BOOTSTRAP, seed: int = 42) -> DataFrame:
    """``compare_runs`` for each contrast (name, baseline, candidate) of evaluated runs."""
    out = None
    for name, baseline, candidate in contrasts:
        part = compare_runs(runs[baseline], runs[candidate], n_bootstrap=n_bootstrap, seed=seed).select(F.lit(name).alias("contrast"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def contrasts_of(variants: list[str], base: str, model: str, first_stage: str = "bm25") -> list[tuple[str, str, str]]:
    """The model and every variant against the first stage, variants against the model, and those beyond ``base`` against it."""
    out = [(f"{c}_vs_{first_stage}", first_stage, c) for c in (model, *variants)]
    out += [(f"{v}_vs_{model}", model, v) for v in variants]
    return out + [(f"{v}_vs_{base}", base, v) for v in variants if v != base]
