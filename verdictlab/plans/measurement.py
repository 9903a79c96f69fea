"""The agreement report of one collection and its rankers, and its files."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictlab.operators import analysis, models, pairs, rankers
from verdictlab.plans.frames import Cell
from verdictlab.sources.config import Experiment, Ranker, dump
from verdictlab.sources.staging import staged

Report = dict[str, DataFrame]


def chosen_rankers(settings: list[Ranker], only_model: str | None = None) -> list[Ranker]:
    """The rankers whose model's name holds ``only_model``; none is an error."""
    found = [s for s in settings if only_model is None or only_model in (s.model or "mock")]
    if not found:
        raise ValueError(f"{only_model!r} is no ranker's model: {[s.model or 'mock' for s in settings]}")
    return found


def feature_set(frame: DataFrame, names: list[str], later: tuple[str, ...] = ()) -> list[str]:
    """The names but those of ``later`` that vary over the frame; a column of one value tells nothing."""
    kept = [n for n in names if n not in later]
    ends = frame.agg(*[x for n in kept for x in (F.min(n).alias(f"min_{n}"), F.max(n).alias(f"max_{n}"))]).first() if kept else None
    return [n for n in kept if ends[f"min_{n}"] != ends[f"max_{n}"]]


def measured(cell: Cell, stored: DataFrame, feature_sets: dict[str, list[str]], gap_set: str | None = None, names: list[str] | None = None, n_bootstrap: int = 2_000) -> Report:
    """The report's frames over stored verdicts: agreement with intervals, consistency (one row), a joint fit for each feature set, and the gap gradient."""
    names = names or cell.axiom_names
    if unknown := set(names) - set(cell.axiom_names):
        raise ValueError(f"not among the cell's axioms: {sorted(unknown)}")
    verdicts = staged(pairs.collapse_verdicts(stored), "verdicts")
    merged = staged(analysis.attach_rank_gap(analysis.merge_pairs(verdicts, cell.axioms), cell.pool), "merged")
    latency = stored.agg((F.avg("latency_ms") if "latency_ms" in stored.columns else F.lit(None).cast("double")).alias("mean_latency_ms"))
    consistency = pairs.consistency_stats(verdicts).join(pairs.triangles(verdicts), F.lit(True)).join(latency, F.lit(True))
    joint, gap_oof = None, None
    for label, columns in feature_sets.items():
        oof, found = models.joint_fit(merged, columns)
        oof = staged(oof, "oof")
        gap_oof = oof if label == gap_set else gap_oof
        part = models.fit_summary(oof).select(F.lit(label).alias("features"), "*")
        joint = part if joint is None else joint.unionByName(part)
    report = {"agreement": analysis.agreement_intervals(merged, names, n_bootstrap), "consistency": consistency, "gradient": analysis.gap_gradient(merged, names, oof=gap_oof)}
    return report | ({"joint_fit": joint} if joint is not None else {})


def write_reports(report: Report, folder: str) -> list[str]:
    """The frames as files, each of which is a small aggregate: one row as JSON, more as CSV; the paths."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    out = []
    for name, df in report.items():
        rows = df.toPandas()
        path = Path(folder, f"{name}.{'json' if len(rows) == 1 else 'csv'}")
        path.write_text(json.dumps(json.loads(rows.to_json(orient="records"))[0], indent=1) if len(rows) == 1 else rows.sort_values(list(rows.columns)).to_csv(index=False))
        out.append(str(path))
    return out


def measure_cell(cell: Cell, settings: list[Ranker], store_path: str, dataset: str, feature_sets: dict[str, list[str]], gap_set: str | None = None, only_model: str | None = None, names: list[str] | None = None, folder: str | None = None, experiment: Experiment | None = None, protocols: str | None = None, call: Callable | None = None, n_bootstrap: int = 2_000) -> dict[str, Report]:
    """For every chosen ranker: collect what verdicts are missing, then the report of ``measured``; written below ``folder`` where one is given, beside the configuration."""
    out = {}
    if folder and experiment is not None:
        dump(experiment, f"{folder}/config.yaml")
    for s in chosen_rankers(settings, only_model):
        stored = rankers.collect_verdicts(dataset, s, cell.pairs, cell.topics, cell.corpus, store_path, protocols, call)
        out[s.model or "mock"] = measured(cell, staged(stored, "collected"), feature_sets, gap_set, names, n_bootstrap)
        if folder:
            write_reports(out[s.model or "mock"], f"{folder}/{(s.model or 'mock').replace('/', '__')}")
    return out
