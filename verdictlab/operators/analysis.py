"""How far axioms agree with verdicts: tables, intervals, covariates, bins, gradients and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictlab.functions.text import coverage, is_question, tokens
from verdictlab.operators.pairs import exact_join
from verdictlab.operators.ranking import interval, resampled
from verdictlab.sources.staging import staged

KEY = ["query_id", "doc_id_1", "doc_id_2"]


def share(part: Column, whole: Column) -> Column:
    """A rate rounded to six places; null over nothing."""
    return F.round(F.when(whole > 0, part / whole), 6)


def merge_pairs(verdicts: DataFrame, axioms: DataFrame) -> DataFrame:
    """Verdicts with axiom columns; every pair must be on both sides once."""
    return exact_join(verdicts, axioms.withColumnRenamed("qid", "query_id"), KEY)


def attach_pool(pairs: DataFrame, pool: DataFrame, *columns: str, strict: bool = False) -> DataFrame:
    """Columns of the pool for both documents, as name_1 and name_2. ``strict`` fails in flight where a document isn't in the pool."""
    for side in ("1", "2"):
        value = lambda c: F.when(F.col("docno").isNotNull() & F.col(c).isNotNull(), F.col(c))
        p = pool.select(F.col("qid").alias("query_id"), F.col("docno").alias(f"doc_id_{side}"), *[value(c).alias(f"{c}_{side}") for c in columns])
        pairs = pairs.join(p, ["query_id", f"doc_id_{side}"], "left")
        if strict:
            lost = F.raise_error(F.concat(F.lit("not in the pool: "), "query_id", F.lit(" "), f"doc_id_{side}"))
            pairs = pairs.withColumns({f"{c}_{side}": F.coalesce(F.col(f"{c}_{side}"), lost.cast(pool.schema[c].dataType)) for c in columns})
    return pairs


def attach_rank_gap(pairs: DataFrame, pool: DataFrame) -> DataFrame:
    """Both documents' ranks and their distance; a document without a rank is an error."""
    return attach_pool(pairs, pool, "rank", strict=True).withColumn("rank_gap", F.abs(F.col("rank_1") - F.col("rank_2")))


def by_axiom(merged: DataFrame, names: list[str]) -> DataFrame:
    """A row a pair and axiom: axiom, pref."""
    return merged.select(*[c for c in merged.columns if c not in names], F.explode(F.array(*[F.struct(F.lit(n).alias("axiom"), F.col(n).alias("pref")) for n in names])).alias("x")).select("*", "x.axiom", "x.pref").drop("x")


def _evaluable() -> Column:
    return (F.col("pref") != 0) & (F.col("model_pref") != 0)


def _agrees() -> Column:
    return _evaluable() & (F.col("pref") == F.col("model_pref"))


def agreement_table(merged: DataFrame, names: list[str]) -> DataFrame:
    out = by_axiom(merged, names).groupBy("axiom").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("pref") != 0).alias("n_active"), F.count_if(_evaluable()).alias("n_evaluable"), F.count_if(_agrees()).alias("agree"))
    return out.select("axiom", "n_pairs", share(F.col("n_active"), F.col("n_pairs")).alias("coverage"), "n_evaluable", share(F.col("agree"), F.col("n_evaluable")).alias("agreement"))


def agreement_intervals(merged: DataFrame, names: list[str], n_bootstrap: int = 2_000, seed: int = 42, min_clusters: int = 1) -> DataFrame:
    """The table with the 95 % interval over resampled queries. Queries are resampled as counts, with one set of draws for all axioms; draws without an evaluable pair don't count."""
    sign = lambda n: F.col(n) * F.col("model_pref")  # noqa: E731  # 1 agrees, -1 disagrees, 0 can't be evaluated
    counts = [x for i, n in enumerate(names) for x in (F.count_if(sign(n) != 0).alias(f"e{i}"), F.count_if(sign(n) > 0).alias(f"a{i}"))]
    each = staged(merged.groupBy("query_id").agg(*counts), "by-query")
    rate = lambda i: F.sum(F.col(f"a{i}") * F.col("times")) / F.nullif(F.sum(F.col(f"e{i}") * F.col("times")), F.lit(0))
    boot = resampled(each, "query_id", {f"r{i}": rate(i) for i in range(len(names))}, n_bootstrap, seed)
    ends = boot.agg(*[interval(F.col(f"r{i}")).alias(f"q{i}") for i in range(len(names))])
    spread = lambda df, **columns: df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("axiom"), *[F.col(f"{c}{i}").alias(k) for k, c in columns.items()]) for i, n in enumerate(names)])).alias("x")).select("x.*")
    clusters = spread(each.agg(*[F.count_if(F.col(f"e{i}") > 0).alias(f"n{i}") for i in range(len(names))]), n_evaluable_queries="n")
    out = agreement_table(merged, names).join(clusters, "axiom").join(spread(ends, q="q"), "axiom", "left")
    end = lambda i: F.round(F.when(F.col("n_evaluable_queries") >= min_clusters, F.col("q")[i]), 6)
    return out.select("axiom", "n_pairs", "coverage", "n_evaluable", "agreement", "n_evaluable_queries", end(0).alias("ci_lo"), end(1).alias("ci_hi"))


def covariates(pairs: DataFrame, pool: DataFrame, topics: DataFrame, corpus: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Signed and magnitude covariates of every pair. Each text is tokenised once a document, then joined to its pairs."""
    used = pairs.select("query_id", F.col("doc_id_1").alias("docno")).union(pairs.select("query_id", F.col("doc_id_2").alias("docno"))).distinct()
    q = topics.select(F.col("qid").alias("query_id"), F.array_distinct(tokens(F.col("query"))).alias("q"), is_question(F.col("query")).alias("question"))
    words = used.join(corpus, "docno").select("query_id", "docno", tokens(F.col("text")).alias("w")).join(q, "query_id")
    shape = words.select("query_id", "docno", F.size("w").cast("double").alias("len"), coverage(F.col("q"), F.col("w")).alias("cov"))
    out = attach_pool(pairs, pool, "rank", "score")
    for side in ("1", "2"):
        out = out.join(shape.select("query_id", F.col("docno").alias(f"doc_id_{side}"), F.col("len").alias(f"len_{side}"), F.col("cov").alias(f"cov_{side}")), ["query_id", f"doc_id_{side}"], "left")
    out = out.join(q.select("query_id", F.size("q").cast("double").alias("query_len"), F.col("question").cast("double").alias("query_is_question")), "query_id", "left")
    d = lambda c: F.col(f"{c}_1") - F.col(f"{c}_2")
    most, least = F.greatest("len_1", "len_2"), F.least("len_1", "len_2")
    out = out.withColumns({
        "d_rank": d("rank").cast("double"), "d_score": F.round(d("score"), 6), "d_len": d("len"), "d_qcov": F.round(d("cov"), 6),
        "rank_gap": F.abs(d("rank")).cast("double"), "score_gap": F.round(F.abs(d("score")), 6), "len_max": most, "len_ratio": F.round(most / F.greatest(least, F.lit(1.0)), 6),
        "rank_max": F.greatest("rank_1", "rank_2").cast("double"), "score_max": F.greatest("score_1", "score_2"),
    })
    columns = ["d_rank", "d_score", "d_len", "d_qcov", "rank_gap", "score_gap", "len_max", "len_ratio", "query_len", "query_is_question", "rank_max", "score_max"]
    if stored is None:
        margins = {m: F.lit(None).cast("double") for m in ("conf_margin_prob", "conf_margin_score")}
        return out.withColumns(margins).select(*KEY, *columns, *margins)
    conf = stored.select("query_id", F.least("doc_id_a", "doc_id_b").alias("doc_id_1"), F.greatest("doc_id_a", "doc_id_b").alias("doc_id_2"), F.abs(F.col("prob_a") - 0.5).alias("p"), F.abs(F.col("score_a") - F.col("score_b")).alias("s"))
    conf = conf.groupBy(*KEY).agg(F.round(F.avg("p"), 6).alias("conf_margin_prob"), F.round(F.avg("s"), 6).alias("conf_margin_score"))
    return out.join(conf, KEY, "left").select(*KEY, *columns, "conf_margin_prob", "conf_margin_score")


def sums_below(df: DataFrame, order: list[str], count: str) -> DataFrame:
    """``df`` (distinct in ``order``) with ``below``: the sum of ``count`` over the rows of the same leading columns and a lesser last one.

    Rows are dealt by ranges and summed within them; only one total a range and leading value comes together, so that no task holds all rows.
    """
    *lead, last = order
    parts = staged(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(*lead, "_part").agg(F.sum(count).alias("_n"))
    bases = totals.select(*lead, "_part", F.coalesce(F.sum("_n").over(before(lead or [F.lit(0)], "_part")), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum(count).over(before([*lead, "_part"], last)), F.lit(0))
    return parts.join(bases, [*lead, "_part"]).withColumn("below", F.col("_base") + inside).drop("_part", "_base")


def quantile_edges(df: DataFrame, names: list[str], bins: int) -> dict[str, list[float]]:
    """Distinct linear quantiles of every column: at most ``bins`` + 1 numbers each, exact. Values are counted first."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("v")) for n in names]))
    counts = df.select(each.alias("x")).select("x.*").filter("v IS NOT NULL").groupBy("name", "v").agg(F.count("*").alias("n"))
    placed = sums_below(counts, ["name", "v"], "n")
    totals = {r["name"]: r["n"] for r in placed.groupBy("name").agg(F.sum("n").alias("n")).collect()}
    wanted = {(name, k) for name, n in totals.items() for i in range(bins + 1) for k in (int(i * (n - 1) / bins), min(n - 1, int(i * (n - 1) / bins) + 1))}
    if not wanted:
        return {n: [] for n in names}
    places = F.broadcast(df.sparkSession.createDataFrame(sorted(wanted), "name string, k long"))  # two a column and bin
    hit = placed.join(places, "name").filter((F.col("below") <= F.col("k")) & (F.col("k") < F.col("below") + F.col("n")))
    at = {(r["name"], r["k"]): r["v"] for r in hit.select("name", "k", "v").collect()}
    out = {n: [] for n in names}
    for name, n in totals.items():
        edges = set()
        for i in range(bins + 1):
            place = i * (n - 1) / bins
            low = int(place)
            a, b = at[name, low], at[name, min(n - 1, low + 1)]
            edges.add(a + (b - a) * (place - low))
        out[name] = sorted(edges)
    return out


def upper_edge(value: Column, edges: list[float]) -> Column:
    """The upper edge of the bin (edge, next edge] that holds the value; the least value belongs to the first bin."""
    label = F.lit(None).cast("double")
    for high in reversed(edges[1:]):
        label = F.when(value <= high, F.lit(high)).otherwise(label)
    return label


def gap_bins(df: DataFrame, gap: str = "rank_gap", max_integer: int = 15, bins: int = 10) -> DataFrame:
    """``gap_bin``: the gap itself where none is over ``max_integer``, else the truncated upper edge of its quantile bin."""
    most = df.agg(F.max(gap)).first()[0]
    if most is None or most <= max_integer:
        return df.withColumn("gap_bin", F.col(gap).cast("int"))
    return df.withColumn("gap_bin", upper_edge(F.col(gap), quantile_edges(df, [gap], bins)[gap]).cast("int"))


def gap_gradient(merged: DataFrame, names: list[str], bins: int = 10, max_integer: int = 15, oof: DataFrame | None = None) -> DataFrame:
    """Per gap bin and axiom: the bin's pairs, decisive rate, consistency, BM25's accuracy as a predictor, then the axiom's evaluable pairs and agreement."""
    df = gap_bins(merged, "rank_gap", max_integer, bins)
    decisive = F.col("model_pref") != 0
    bm25 = F.signum(F.col("rank_2") - F.col("rank_1")) == F.col("model_pref")
    extra = []
    if oof is not None:
        df = df.join(oof.select(*KEY, "oof_correct"), KEY, "left")
        extra = [F.round(F.avg(F.col("oof_correct").cast("int")), 6).alias("joint_cv_accuracy")]
    context = df.groupBy("gap_bin").agg(
        F.count("*").alias("n_pairs"), F.round(F.avg(decisive.cast("int")), 6).alias("decisive_rate"), F.round(F.avg(F.when(F.col("n_presentations") >= 2, F.col("position_consistent").cast("int"))), 6).alias("position_consistency"),
        share(F.count_if(decisive & bm25), F.count_if(decisive)).alias("bm25_accuracy"), *extra,
    )
    per = by_axiom(df, names).groupBy("gap_bin", "axiom").agg(F.count_if(_evaluable()).alias("n_evaluable"), F.count_if(_agrees()).alias("agree"))
    return context.join(per.select("gap_bin", "axiom", "n_evaluable", share(F.col("agree"), F.col("n_evaluable")).alias("agreement")), "gap_bin")


def profiles(df: DataFrame, names: list[str], bins: int = 5) -> DataFrame:
    """Per covariate and bin: pairs, accuracy (column oof_correct), residual rate, mean signed verdict (column y_true). Values of few kinds are their own bins."""
    few = df.agg(*[F.count_distinct(n).alias(n) for n in names]).first().asDict() if names else {}
    edges = quantile_edges(df, many, bins) if (many := [n for n in names if few[n] > bins]) else {}
    kinds = [F.struct(F.lit(n).alias("covariate"), F.round(F.col(n).cast("double") if few[n] <= bins else upper_edge(F.col(n), edges[n]), 3).alias("bin"), F.col(n).isNotNull().alias("known")) for n in names]
    rows = df.select("oof_correct", "y_true", F.explode(F.array(*kinds)).alias("x")).select("oof_correct", "y_true", "x.*").filter("known")
    right = F.col("oof_correct").cast("int")
    return rows.groupBy("covariate", "bin").agg(F.count("*").alias("n_pairs"), F.round(F.avg(right), 6).alias("oof_accuracy"), F.round(F.avg(1 - right), 6).alias("residual_rate"), F.round(F.avg(2 * F.col("y_true").cast("int") - 1), 6).alias("mean_signed_verdict"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """The exact area under the ROC curve (ties count half), with both classes' counts; null with one class.

    Scores are counted first, so the running sum goes over distinct scores.
    """
    each = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("n"))
    placed = sums_below(each, ["s"], "n")
    out = placed.withColumn("w", F.col("p") * (F.col("below") + F.col("n") / 2.0)).agg(F.sum("w").alias("w"), F.sum("p").alias("n_positive"), F.sum("n").alias("n_negative"))
    return out.select("n_positive", "n_negative", F.round(F.when((F.col("n_positive") > 0) & (F.col("n_negative") > 0), F.col("w") / (F.col("n_positive") * F.col("n_negative"))), 6).alias("auc"))


def cross_entropy(y: Column, p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return F.avg(-F.when(y, F.log(q)).otherwise(F.log(1 - q)))


def information(df: DataFrame, y: str, p: str, null: str) -> DataFrame:
    """Cross-entropy of the null and the model, the gain, and McFadden's pseudo R squared."""
    out = df.agg(F.count("*").alias("n"), cross_entropy(F.col(y), F.col(null)).alias("a"), cross_entropy(F.col(y), F.col(p)).alias("b"))
    return out.select("n", F.round("a", 6).alias("null_log_loss"), F.round("b", 6).alias("model_log_loss"), F.round(F.col("a") - F.col("b"), 6).alias("gain"), F.round(F.when(F.col("a") > 0, 1 - F.col("b") / F.col("a")), 6).alias("pseudo_r2"))


def single_order_sensitivity(consistency: Column) -> Column:
    """The accuracy that one presentation can reach at a position consistency; a half where that is a half or less."""
    return F.when(consistency.isNull() | F.isnan(consistency), F.lit(None).cast("double")).when(consistency <= 0.5, 0.5).otherwise(0.5 * (1 + F.sqrt(F.greatest(2 * consistency - 1, F.lit(0.0)))))


def regression_fidelity(df: DataFrame, target: str, predicted: str) -> DataFrame:
    """Spearman correlation (average ranks), mean absolute error, and R squared."""

    def average_rank(c: str) -> DataFrame:
        placed = sums_below(df.groupBy(F.col(c).alias(c)).agg(F.count("*").alias("m")), [c], "m")
        return placed.select(c, (F.col("below") + (F.col("m") + 1) / 2.0).alias(f"r_{c}"))

    ranked = df.select(target, predicted).join(average_rank(target), target).join(average_rank(predicted), predicted)
    t, p = F.col(target), F.col(predicted)
    out = ranked.agg(F.count("*").alias("n"), F.corr(f"r_{target}", f"r_{predicted}").alias("c"), F.avg(F.abs(t - p)).alias("e"), F.sum((t - p) * (t - p)).alias("res"), F.var_pop(target).alias("v"))
    return out.select("n", F.round("c", 6).alias("spearman"), F.round("e", 6).alias("mae"), F.round(F.when(F.col("v") > 0, 1 - F.col("res") / (F.col("v") * F.col("n"))), 6).alias("r2"))


def candidate_agreement(merged: DataFrame, names: list[str], eligible: DataFrame | None = None, n_bootstrap: int = 2_000, seed: int = 42, min_clusters: int = 5) -> DataFrame:
    """The agreement table with intervals (none below ``min_clusters`` queries with an evaluable pair), and per axiom: eligible and active queries,
    coverage among the pairs of eligible queries, positives and negatives. ``eligible``: query_id, axiom."""
    long = by_axiom(merged, names).select("query_id", "axiom", "pref")
    if eligible is not None:
        long = long.join(eligible.select("query_id", "axiom", F.lit(True).alias("ok")).distinct(), ["query_id", "axiom"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    else:
        long = long.withColumn("ok", F.lit(True))
    active, ok = F.col("pref") != 0, F.col("ok")
    out = long.groupBy("axiom").agg(
        F.count_distinct(F.when(ok, F.col("query_id"))).alias("n_eligible_queries"), F.count_distinct(F.when(active, F.col("query_id"))).alias("n_active_queries"),
        F.count_distinct("query_id").alias("n_queries"), F.count_if(ok).alias("n_ok"), F.count_if(ok & active).alias("n_ok_active"), F.count_if(F.col("pref") > 0).alias("n_positive"), F.count_if(F.col("pref") < 0).alias("n_negative"),
    )
    table = agreement_intervals(merged, names, n_bootstrap, seed, min_clusters)
    return table.join(out, "axiom").select(*table.columns, "n_active_queries", "n_queries", "n_eligible_queries", share(F.col("n_ok_active"), F.col("n_ok")).alias("eligible_pair_coverage"), "n_positive", "n_negative")


def log_loss(y: Column, p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return -F.when(y, F.log(q)).otherwise(F.log(1 - q))


def incremental_fidelity(df: DataFrame, p_base: str, p_more: str, label: str = "y_true", n_bootstrap: int = 2_000, seed: int = 42, macro: bool = False) -> DataFrame:
    """What a second model adds in accuracy and log-loss over the same pairs, with 95 % intervals over resampled queries.

    The mean is over pairs, or (``macro``) over the queries' means. Queries are resampled as sums and counts.
    """
    y = F.col(label)
    right = lambda p: ((F.col(p) >= 0.5) == y).cast("int")
    measures = {"accuracy": right(p_more) - right(p_base), "log_loss": log_loss(y, F.col(p_base)) - log_loss(y, F.col(p_more))}
    total = {k: F.round(F.avg(v) if macro else F.sum(v).cast("double"), 9) for k, v in measures.items()}
    each = staged(df.groupBy("query_id").agg((F.lit(1) if macro else F.count("*")).alias("n"), *[v.alias(k) for k, v in total.items()]), "lifts")
    boot = resampled(each, "query_id", {k: F.sum(F.col(k) * F.col("times")) / F.sum(F.col("n") * F.col("times")) for k in measures}, n_bootstrap, seed)
    ends = boot.agg(*[interval(F.col(k)).alias(f"q_{k}") for k in measures])
    lift = each.agg(*[(F.sum(k) / F.sum("n")).alias(k) for k in measures])
    rows = lift.join(ends, F.lit(True)).select(F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.round(k, 6).alias("lift"), F.round(F.col(f"q_{k}")[0], 6).alias("ci_lo"), F.round(F.col(f"q_{k}")[1], 6).alias("ci_hi")) for k in measures])).alias("x"))
    return rows.select("x.*")


def adequacy_evaluation(df: DataFrame, one: str, two: str, verdict: str = "model_pref", dead_band: float = 0.10) -> DataFrame:
    """How two pointwise scores tell the verdict: pairs, decisive ones, the share outside the dead band, and there the agreement of signs."""
    gap = F.col(one) - F.col(two)
    decisive = F.col(verdict) != 0
    clear = decisive & (F.abs(gap) > dead_band)
    some = df.filter(F.col(one).isNotNull() & F.col(two).isNotNull())
    out = some.agg(F.count("*").alias("n_pairs"), F.count_if(decisive).alias("n_decisive"), F.count_if(clear).alias("n_clear"), F.count_if(clear & (F.signum(gap) == F.col(verdict))).alias("agree"))
    area = auc(some.filter(decisive).select(gap.alias("gap"), (F.col(verdict) > 0).alias("y")), "gap", "y").select("auc")
    return out.join(area, F.lit(True)).select("n_pairs", "n_decisive", share(F.col("n_clear"), F.col("n_decisive")).alias("discriminating_coverage"), share(F.col("agree"), F.col("n_clear")).alias("sign_agreement"), "auc")


def residual_model(df: DataFrame, axioms: list[str], covariates_: list[str], folds: int = 5, n_bootstrap: int = 2_000, seed: int = 42) -> DataFrame:
    """What covariates add to axioms in out-of-fold accuracy, over the same folds: a row with pairs, queries, both accuracies and the lift, by queries (with its interval) and by pairs.

    Covariates are standardised by the training folds; pairs that lack one don't count. ``df`` has KEY, model_pref, the axioms and the covariates.
    """
    from verdictlab.operators.models import joint_fit

    if not axioms:
        raise ValueError("the axioms' columns are needed")
    rows = staged(df.filter("model_pref <> 0").na.drop(subset=[*axioms, *covariates_]), "residual")
    base = joint_fit(rows, axioms, folds)[0].select(*KEY, "y_true", F.col("oof_prob").alias("p_base"), F.col("oof_correct").cast("int").alias("base"))
    more = joint_fit(rows, [*axioms, *covariates_], folds, standardise=covariates_)[0].select(*KEY, F.col("oof_prob").alias("p_more"), F.col("oof_correct").cast("int").alias("more"))
    both = staged(exact_join(base, more, KEY), "both")
    by_pair = both.agg(F.count("*").alias("n_pairs"), F.round(F.avg("base"), 6).alias("pair_micro_base_accuracy"), F.round(F.avg("more"), 6).alias("pair_micro_cov_accuracy"), F.round(F.avg(F.col("more") - F.col("base")), 6).alias("pair_micro_lift"))
    queries = both.groupBy("query_id").agg(F.avg("base").alias("base"), F.avg("more").alias("more"))
    by_query = queries.agg(F.count("*").alias("n_queries"), F.round(F.avg("base"), 6).alias("base_accuracy"), F.round(F.avg("more"), 6).alias("cov_accuracy"))
    lift = incremental_fidelity(both, "p_base", "p_more", n_bootstrap=n_bootstrap, seed=seed, macro=True).filter("measure = 'accuracy'").select("lift", F.col("ci_lo").alias("lift_ci_lo"), F.col("ci_hi").alias("lift_ci_hi"))
    return by_pair.join(by_query, F.lit(True)).join(lift, F.lit(True))


def variant_profiles(predictions: dict[str, DataFrame], covariates_: DataFrame, names: list[str], bins: int = 5) -> DataFrame:
    """``profiles`` of every variant's out-of-fold predictions (KEY, y_true, oof_correct) over the same covariates."""
    out = None
    for variant, df in predictions.items():
        part = profiles(exact_join(df.select(*KEY, "y_true", "oof_correct"), covariates_.join(df.select(*KEY), KEY, "left_semi"), KEY), names, bins).select(F.lit(variant).alias("variant"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def join_candidate(base: DataFrame, candidate: DataFrame, collection: str) -> DataFrame:
    """A collection's pairs with the columns of a candidate, pair by pair, and a group that is unique over collections."""
    joined = exact_join(base, candidate.withColumnRenamed("qid", "query_id"), KEY)
    return joined.withColumns({"collection": F.lit(collection), "group_id": F.concat(F.lit(f"{collection}:"), "query_id")})


def distribution(df: DataFrame, value: str) -> DataFrame:
    """How often each value occurs."""
    return df.groupBy(value).agg(F.count("*").alias("n"))


def tie_diagnostics(merged: DataFrame, vote: Column) -> DataFrame:
    """One row: ties and decisions of the verdicts and of a vote over the same pairs, and the reasons' counts."""
    reasons = [F.count_if(F.col("collapse_reason") == r).alias(f"n_{r}") for r in ("decisive", "model_tie", "order_disagreement")]
    target = F.col("model_pref") == 0
    return merged.agg(F.count_if(target).alias("target_ties"), F.count_if(~target).alias("target_decisive"), F.count_if(vote == 0).alias("vote_ties"), F.count_if(vote != 0).alias("vote_decisions"), *reasons)
