"""Small models over pair features: query-grouped folds, logistic and ridge fits, out-of-fold predictions and their fidelity.

Ternary features make few patterns, so rows are counted by (fold, features, label) in Spark and the fits run on those counts. Where features are continuous
or the patterns many, the same fits are made by Newton steps whose sums come from the executors, a row a partition and fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictlab.sources.staging import staged

KEY = ["query_id", "doc_id_1", "doc_id_2"]
#: Feature patterns that the driver takes; beyond, sums do.
MAX_PATTERNS = 200_000
#: Groups that are sent to all executors; a table of more is joined.
SENT_GROUPS = 200_000


def assign_folds(df: DataFrame, group: str = "query_id", folds: int = 5) -> DataFrame:
    """group, fold: groups by size (then name), each to the fold with the fewest rows so far. Groups are queries: a row each comes to the driver."""
    sizes = sorted(((r["n"], r[group]) for r in df.groupBy(group).agg(F.count("*").alias("n")).collect()), key=lambda x: (-x[0], x[1]))
    k = min(folds, len(sizes))
    if k < 2:
        raise ValueError("folds need two groups or more")
    load, out = [0] * k, []
    for n, g in sizes:
        f = min(range(k), key=lambda i: (load[i], i))
        load[f] += n
        out.append((g, f))
    table = df.sparkSession.createDataFrame(out, f"{group} string, fold int")
    return F.broadcast(table) if len(out) <= SENT_GROUPS else table


def check_folds(df: DataFrame, group: str = "query_id") -> None:
    """Fails if a group is in more than one fold, or has none."""
    bad = df.groupBy(group).agg(F.count_distinct("fold").alias("n"), F.count_if(F.col("fold").isNull()).alias("none")).filter("n <> 1 OR none > 0").limit(3).collect()
    if bad:
        raise ValueError(f"groups that aren't in one fold: {[r[group] for r in bad]}")


def _with_folds(df: DataFrame, folds: int, group: str = "query_id") -> DataFrame:
    rows = staged(df.join(assign_folds(df, group, folds), group), "folded")
    check_folds(rows, group)
    return rows


def newton_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, c: float = 1.0) -> np.ndarray:
    """Coefficients, then the intercept, of the L2-regularised logistic fit with inverse strength ``c``; the intercept is free."""
    z = np.column_stack([x, np.ones(len(x))])
    theta = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -35, 35)))
        theta, size = _newton_step(theta, z.T @ (w * (p - y)), (z * (w * np.maximum(p * (1 - p), 1e-12))[:, None]).T @ z, c)
        if size < 1e-10:
            break
    return theta


def _newton_step(theta: np.ndarray, g: np.ndarray, h: np.ndarray, c: float) -> tuple[np.ndarray, float]:
    """The parameters after a step along the gradient and second derivatives of the loss, and the step's size."""
    pull = np.r_[np.ones(len(theta) - 1) / c, 0.0]
    step = np.linalg.solve(h + np.diag(pull) + 1e-12 * np.eye(len(theta)), g + pull * theta)
    size = float(np.abs(step).max())
    return theta - step * min(1.0, 5.0 / max(1e-12, size)), size


def fits_by_sums(rows: DataFrame, features: list[str], scales: dict[int, tuple[np.ndarray, np.ndarray]], c: float = 1.0) -> dict[int, np.ndarray]:
    """``newton_logistic`` without each fold (and of all rows, as -1) over rows with fold and _y, features less a fold's means over its deviations.

    A pass sends a gradient and second derivatives a partition and fit.
    """
    width = len(features) + 1
    thetas, left = {k: np.zeros(width) for k in scales}, set(scales)
    data = rows.select("fold", "_y", *[F.col(f).cast("double").alias(f) for f in features])
    for _ in range(60):
        now = {k: (thetas[k], *scales[k]) for k in sorted(left)}

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            sums = {k: np.zeros(width * (width + 1)) for k in now}
            for b in batches:
                fold, y = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False).astype(float)
                x = np.column_stack([col.to_numpy() for col in b.columns[2:]]) if b.num_rows else np.zeros((0, width - 1))
                for k, (theta, mean, dev) in now.items():
                    train = fold != k
                    z = np.column_stack([(x[train] - mean) / dev, np.ones(int(train.sum()))])
                    p = 1 / (1 + np.exp(-np.clip(z @ theta, -35, 35)))
                    sums[k][:width] += z.T @ (p - y[train])
                    sums[k][width:] += ((z * np.maximum(p * (1 - p), 1e-12)[:, None]).T @ z).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["fit", "sums"])

        total = {k: np.zeros(width * (width + 1)) for k in now}
        for r in data.mapInArrow(run, "fit int, sums array<double>").collect():
            total[r["fit"]] += np.array(r["sums"])
        for k, v in total.items():
            thetas[k], size = _newton_step(thetas[k], v[:width], v[width:].reshape(width, width), c)
            if size < 1e-10:
                left.discard(k)
        if not left:
            break
    # back to the features as they are
    out = {}
    for k, theta in thetas.items():
        mean, dev = scales[k]
        out[k] = np.r_[theta[:-1] / dev, theta[-1] - (theta[:-1] * mean / dev).sum()]
    return out


def linear(features: list[str], theta) -> Column:
    out = F.lit(float(theta[-1]))
    for f, t in zip(features, theta[:-1], strict=True):
        out = out + F.col(f) * float(t)
    return out


def probability(features: list[str], fits: dict[int, np.ndarray]) -> Column:
    out = F.lit(None).cast("double")
    for k, theta in fits.items():
        out = F.when(F.col("fold") == k, 1 / (1 + F.exp(-linear(features, theta)))).otherwise(out)
    return out


def fold_fits(rows: DataFrame, features: list[str], standardise: tuple[str, ...] | list[str] = ()) -> tuple[dict[int, np.ndarray], dict[int, float], np.ndarray]:
    """(fit without each fold, share of positives without each fold, fit of all) over rows with fold and _y (boolean). ``standardise``: features to scale by the training rows."""
    moments = [F.sum(F.col(f).cast("double")).alias(f"s_{f}") for f in standardise] + [F.sum(F.col(f).cast("double") * F.col(f)).alias(f"q_{f}") for f in standardise]
    by = {r["fold"]: r for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.count_if("_y").alias("y"), *moments).collect()}
    if not by:
        raise ValueError("no decisive pair")
    nulls, scales = {}, {}
    for k in (*sorted(by), -1):
        train = [r for f, r in by.items() if f != k]
        n, y = sum(r["n"] for r in train), sum(r["y"] for r in train)
        if not 0 < y < n:
            raise ValueError("a training fold has one class")
        nulls[k] = y / n
        mean, dev = np.zeros(len(features)), np.ones(len(features))
        for i, f in enumerate(features):
            if f in standardise:
                mean[i] = sum(r[f"s_{f}"] for r in train) / n
                dev[i] = np.sqrt(max(0.0, sum(r[f"q_{f}"] for r in train) / n - mean[i] ** 2)) or 1.0
        scales[k] = mean, dev
    del nulls[-1]
    counts = [] if standardise else rows.groupBy("fold", "_y", *features).agg(F.count("*").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if standardise or len(counts) > MAX_PATTERNS:
        fits = fits_by_sums(rows, features, scales)
        return fits, nulls, fits.pop(-1)
    counts.sort(key=lambda r: tuple(r))
    fold, y, n = (np.array([r[c] for r in counts]) for c in ("fold", "_y", "n"))
    x = np.array([[float(r[f]) for f in features] for r in counts])
    fit = lambda k: newton_logistic(x[fold != k], y[fold != k].astype(float), n[fold != k].astype(float))
    return {k: fit(k) for k in nulls}, nulls, fit(-1)


def joint_fit(merged: DataFrame, features: list[str], folds: int = 5, standardise: tuple[str, ...] | list[str] = ()) -> tuple[DataFrame, dict]:
    """Out-of-fold predictions of decisive pairs (y_true, oof_prob, oof_correct, oof_null_prob, oof_null_correct, vote_correct, fold), and the fits.

    A vote is the sign of the features' sum; where it abstains, the training fold's majority votes.
    """
    if not features:
        raise ValueError("a fit needs features")
    rows = _with_folds(merged.filter("model_pref <> 0").withColumn("_y", F.col("model_pref") > 0), folds)
    fits, nulls, full = fold_fits(rows, features, standardise)
    null = F.lit(None).cast("double")
    for k, v in nulls.items():
        null = F.when(F.col("fold") == k, F.lit(v)).otherwise(null)
    votes = sum((F.col(f) for f in features[1:]), F.col(features[0]))
    scored = rows.select(*KEY, "fold", F.col("_y").alias("y_true"), probability(features, fits).alias("oof_prob"), null.alias("oof_null_prob"), votes.alias("votes"))
    right = lambda p: (F.col(p) >= 0.5) == F.col("y_true")
    vote = F.when(F.col("votes") == 0, F.col("oof_null_prob") >= 0.5).otherwise(F.col("votes") > 0)
    out = scored.select(*KEY, "fold", "y_true", "oof_prob", right("oof_prob").alias("oof_correct"), "oof_null_prob", right("oof_null_prob").alias("oof_null_correct"), (vote == F.col("y_true")).alias("vote_correct"))
    return out, {"fits": fits, "nulls": nulls, "full": full, "features": features}


def coefficients(found: dict, spark) -> DataFrame:
    """term, coefficient of the fit of all rows, the largest in size first; the intercept comes last."""
    rows = sorted(zip(found["features"], map(float, found["full"][:-1]), strict=True), key=lambda r: (-abs(r[1]), r[0]))
    return spark.createDataFrame([(i, *r) for i, r in enumerate([*rows, ("(intercept)", float(found["full"][-1]))])], "place int, term string, coefficient double")


def fit_summary(oof: DataFrame) -> DataFrame:
    """One row over ``joint_fit``'s predictions: pairs, base rate, the accuracy of fit, null and vote, and the area under the curve."""
    from verdictlab.operators.analysis import auc

    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    base = F.avg(F.col("y_true").cast("int"))
    out = oof.agg(F.count("*").alias("n_decisive_pairs"), F.round(F.greatest(base, 1 - base), 6).alias("base_rate"), rate("oof_null_correct").alias("cv_null_accuracy"), rate("vote_correct").alias("majority_vote_accuracy"), rate("oof_correct").alias("cv_accuracy"))
    return out.join(auc(oof, "oof_prob", "y_true").select(F.col("auc").alias("cv_auc")), F.lit(True))


def decompose(merged: DataFrame, features: list[str], folds: int = 5, nonlinear: bool = False, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(one row: the fit's summary, its gain over the null in accuracy and information, the accuracy that one presentation can reach, and with ``nonlinear`` what
    boosted trees add; the out-of-fold predictions with ``is_residual``)."""
    from verdictlab.operators.analysis import information, single_order_sensitivity

    oof = staged(joint_fit(merged, features, folds)[0].withColumn("is_residual", ~F.col("oof_correct")), "oof")
    out = fit_summary(oof).join(information(oof, "y_true", "oof_prob", "oof_null_prob").drop("n"), F.lit(True))
    consistency = merged.agg(F.avg(F.when(F.col("n_presentations") >= 2, F.col("position_consistent").cast("int"))).alias("c"))
    out = out.join(consistency.select(F.round(single_order_sensitivity(F.col("c")), 6).alias("single_order_accuracy_sensitivity")), F.lit(True))
    out = out.withColumns({"oof_error_fraction": F.round(1 - F.col("cv_accuracy"), 6), "accuracy_gain_over_base": F.round(F.col("cv_accuracy") - F.col("cv_null_accuracy"), 6)})
    if nonlinear:
        accuracy = nonlinear_accuracy(merged, features, folds, seed)
        out = out.withColumns({"nonlinear_cv_accuracy": F.round(F.lit(accuracy), 6), "nonlinear_headroom": F.round(F.lit(accuracy) - F.col("cv_accuracy"), 6)})
    return out, oof


def paired_predictions(one: DataFrame, two: DataFrame) -> DataFrame:
    """The out-of-fold predictions of two fits over the same pairs side by side: y_true, p_base, p_more."""
    from verdictlab.operators.pairs import exact_join

    return exact_join(one.select(*KEY, "y_true", F.col("oof_prob").alias("p_base")), two.select(*KEY, F.col("oof_prob").alias("p_more")), KEY)


def surrogate(merged: DataFrame, features: list[str], folds: int = 5) -> tuple[DataFrame, dict]:
    """Predictions for all pairs by fits on the decisive pairs of the other folds: fold, target_pref, surrogate_prob, surrogate_pref, correct_on_decisive (null on ties)."""
    rows = _with_folds(merged.withColumn("_y", F.col("model_pref") > 0), folds)
    fits, _, full = fold_fits(rows.filter("model_pref <> 0"), features)
    out = rows.withColumn("surrogate_prob", probability(features, fits)).withColumn("surrogate_pref", F.signum(F.round(F.col("surrogate_prob") - 0.5, 12)).cast("int"))
    right = F.when(F.col("model_pref") != 0, F.col("surrogate_pref") == F.col("model_pref"))
    return out.select(*KEY, "fold", F.col("model_pref").alias("target_pref"), *features, "surrogate_prob", "surrogate_pref", right.alias("correct_on_decisive")), {"fits": fits, "full": full, "features": features}


def feature_zero_effect(predicted: DataFrame, features: list[str], fits: dict[int, np.ndarray]) -> DataFrame:
    """For each feature: pairs and queries whose preference changes when it is zero under the fits as they are. A zeroed feature takes its term out of the fold's sum."""
    by_fold = lambda i: F.get(F.array(*[F.lit(float(fits[k][i]) if k in fits else None).cast("double") for k in range(max(fits) + 1)]), F.col("fold"))
    terms = [by_fold(i) * F.col(f) for i, f in enumerate(features)]
    rows = staged(predicted.select("query_id", F.array(*terms).alias("terms"), by_fold(-1).alias("rest")), "terms")
    rows = rows.withColumn("whole", F.col("rest") + F.aggregate("terms", F.lit(0.0), lambda a, x: a + x))
    pref = lambda z: F.signum(F.round(1 / (1 + F.exp(-z)) - 0.5, 12))
    long = rows.select("query_id", "whole", F.posexplode("terms").alias("i", "term")).filter(pref(F.col("whole")) != pref(F.col("whole") - F.col("term")))
    found = long.groupBy("i").agg(F.count("*").alias("pairs"), F.count_distinct("query_id").alias("queries"))
    names = predicted.sparkSession.createDataFrame(list(enumerate(features)), "i int, feature string")
    return names.join(found, "i", "left").select("feature", F.coalesce("pairs", F.lit(0)).alias("pairs"), F.coalesce("queries", F.lit(0)).alias("queries"))


def fidelity(predicted: DataFrame) -> DataFrame:
    """One row: pairs and queries, accuracy over decisive pairs, its mean over queries, area under the curve, log-loss, ties of the target and the surrogate, forced decisions."""
    from verdictlab.operators.analysis import auc, log_loss

    rows = staged(predicted.select("query_id", "target_pref", "surrogate_prob", "surrogate_pref", "correct_on_decisive"), "predicted")
    decisive = F.col("target_pref") != 0
    right, loss = F.col("correct_on_decisive").cast("int"), F.when(decisive, log_loss(F.col("target_pref") > 0, F.col("surrogate_prob")))
    each = rows.groupBy("query_id").agg(F.count("*").alias("pairs"), F.avg(right).alias("macro"), F.sum(right).alias("right"), F.count_if(decisive).alias("n"), F.sum(loss).alias("loss"), F.count_if(~decisive).alias("ties"), F.count_if(F.col("surrogate_pref") == 0).alias("own_ties"), F.count_if(~decisive & (F.col("surrogate_pref") != 0)).alias("forced"))
    out = each.agg(F.sum("pairs").alias("n_pairs"), F.count("*").alias("n_queries"), F.sum("n").alias("n_decisive"), F.round(F.sum("right") / F.sum("n"), 6).alias("accuracy"), F.round(F.avg("macro"), 6).alias("query_macro_accuracy"), F.round(F.sum("loss") / F.sum("n"), 6).alias("log_loss"), F.sum("ties").alias("n_ties"), F.sum("own_ties").alias("n_surrogate_ties"), F.sum("forced").alias("n_forced"))
    area = auc(rows.filter(decisive).select("surrogate_prob", (F.col("target_pref") > 0).alias("y")), "surrogate_prob", "y").select("auc")
    return out.join(area, F.lit(True))


def _ridge(sums: list, features: list[str], alpha: float) -> np.ndarray:
    """Coefficients, then the intercept, of the ridge fit on standardised features, from sums and products of the features and the target."""
    k, n = len(features), sum(r["n"] for r in sums)
    if not n:
        raise ValueError("no row with a target")
    s = np.array([sum(r[f"s_{i}"] for r in sums) for i in range(k + 1)]) / n
    p = np.array([[sum(r[f"p_{min(i, j)}_{max(i, j)}"] for r in sums) for j in range(k + 1)] for i in range(k + 1)]) / n - np.outer(s, s)
    scale = np.sqrt(np.maximum(np.diag(p)[:k], 0))
    scale[scale == 0] = 1.0
    beta = np.linalg.solve(p[:k, :k] / np.outer(scale, scale) * n + alpha * np.eye(k), p[:k, k] / scale * n) / scale
    return np.r_[beta, s[k] - beta @ s[:k]]


def _moments(features: list[str], target: str) -> list[Column]:
    names = [*features, target]
    return [F.sum(F.col(a) * F.col(b)).alias(f"p_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j] + [F.sum(a).alias(f"s_{i}") for i, a in enumerate(names)] + [F.count("*").alias("n")]


def ridge_fit(df: DataFrame, features: list[str], target: str, alpha: float = 1.0) -> np.ndarray:
    """The ridge fit over all rows with a target, from one row of sums."""
    return _ridge([df.filter(F.col(target).isNotNull()).agg(*_moments(features, target)).first()], features, alpha)


def ridge_predict(df: DataFrame, features: list[str], theta: np.ndarray, low: float = 0.0, high: float = 3.0) -> DataFrame:
    """``df``, of whatever collection, with ``predicted`` by a fit as it is."""
    return df.withColumn("predicted", F.least(F.greatest(linear(features, theta), F.lit(low)), F.lit(high)))


def ridge_out_of_fold(df: DataFrame, features: list[str], target: str, alpha: float = 1.0, folds: int = 5, low: float = 0.0, high: float = 3.0, group: str = "qid") -> DataFrame:
    """``df`` with fold and predicted: ridge on training-fold standardised features over rows with a target, applied to all rows, clipped.

    Each fold sends its sums and products: the normal equations of any training set are sums of those.
    """
    rows = _with_folds(df, folds, group)
    sums = {r["fold"]: r for r in rows.filter(F.col(target).isNotNull()).groupBy("fold").agg(*_moments(features, target)).collect()}
    out = F.lit(None).cast("double")
    for fold in [r["fold"] for r in rows.select("fold").distinct().collect()]:
        out = F.when(F.col("fold") == fold, linear(features, _ridge([r for f, r in sums.items() if f != fold], features, alpha))).otherwise(out)
    return rows.withColumn("predicted", F.least(F.greatest(out, F.lit(low)), F.lit(high)))


def adaptation_split(df: DataFrame, n_train: int, seed: int = 42, group: str = "qid") -> DataFrame:
    """``df`` with ``in_train``: the ``n_train`` groups that come first by a seeded hash. At least one group must be left."""
    groups = df.select(group).distinct()
    if not 0 < n_train < groups.count():
        raise ValueError("a split needs groups on both sides")
    first = groups.orderBy(F.md5(F.concat_ws("-", F.lit(str(seed)), group)), group).limit(n_train).withColumn("in_train", F.lit(True))
    return df.join(F.broadcast(first) if n_train <= SENT_GROUPS else first, group, "left").withColumn("in_train", F.coalesce("in_train", F.lit(False)))


def residual_clusters(df: DataFrame, features: list[str], k: int = 4, seed: int = 42, exemplars: int = 3, starts: int = 10) -> DataFrame:
    """Clusters of residual pairs by standardised covariates: size, mean covariates, and the pairs nearest to the centre."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import Window

    rows = VectorAssembler(inputCols=features, outputCol="v").transform(df.na.drop(subset=features))
    rows = staged(StandardScaler(inputCol="v", outputCol="z", withMean=True).fit(rows).transform(rows), "standardised")
    if rows.limit(k).count() < k:
        return df.sparkSession.createDataFrame([], "cluster int, n bigint, exemplars string, " + ", ".join(f"mean_{f} double" for f in features))
    # the start with the least squared distance to the centres
    model = min((KMeans(k=k, seed=seed + i, featuresCol="z", predictionCol="cluster").fit(rows) for i in range(starts)), key=lambda m: m.summary.trainingCost)
    centres = model.clusterCenters()
    marked = model.transform(rows).withColumn("z", vector_to_array("z"))
    far = F.lit(None).cast("double")
    for i, c in enumerate(centres):
        far = F.when(F.col("cluster") == i, sum(((F.col("z")[j] - float(x)) ** 2 for j, x in enumerate(c)), F.lit(0.0))).otherwise(far)
    marked = marked.withColumn("far", far)
    near = marked.withColumn("place", F.row_number().over(Window.partitionBy("cluster").orderBy("far", *KEY))).filter(F.col("place") <= exemplars)
    near = near.groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", F.concat_ws(":", *KEY).alias("k")))), lambda x: x["k"]), ", ").alias("exemplars"))
    return marked.groupBy("cluster").agg(F.count("*").alias("n"), *[F.round(F.avg(f), 6).alias(f"mean_{f}") for f in features]).join(near, "cluster").select("cluster", "n", "exemplars", *[f"mean_{f}" for f in features])


def nonlinear_accuracy(df: DataFrame, features: list[str], folds: int = 5, seed: int = 42, trees: int = 100) -> float:
    """Out-of-fold accuracy of boosted trees of depth two. The training rows come to few partitions, as each tree is a job over all of them."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    decisive = _with_folds(df.filter("model_pref <> 0").withColumn("label", (F.col("model_pref") > 0).cast("double")), folds)
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(decisive).select("fold", "label", "features")
    right = total = 0
    for k in [r["fold"] for r in decisive.select("fold").distinct().collect()]:
        model = GBTClassifier(maxDepth=2, maxIter=trees, seed=seed).fit(rows.filter(F.col("fold") != k))
        r = model.transform(rows.filter(F.col("fold") == k)).agg(F.count_if(F.col("prediction") == F.col("label")).alias("r"), F.count("*").alias("n")).first()
        right, total = right + r["r"], total + r["n"]
    return right / total if total else float("nan")
