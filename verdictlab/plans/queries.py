"""Queries by name, each with the SQL that it must equal. A name begins with the operator's number in the survey."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlab.operators import pairs, ranking
from verdictlab.plans import sql as S
from verdictlab.plans.frames import Cell
from verdictlab.sources.staging import fresh, staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f: Callable[[Cell], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Cell(spark, sf_dir))
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


@query("flagship", S.sql(S.comparison("bm25_metrics", "copeland_metrics")))
def flagship(c: Cell) -> DataFrame:
    """BM25 pool, pairs, verdicts in both orders, Copeland ranking, and its comparison with BM25."""
    return ranking.compare_runs(ranking.evaluate(c.pool, c.qrels), ranking.evaluate(c.copeland, c.qrels))


@query("s1_bm25_pool", S.sql("SELECT qid, docno, CAST(rank AS INTEGER) AS rank, score FROM pool"))
def s1(c: Cell) -> DataFrame:
    return c.pool


@query("s4_query_terms", S.sql("SELECT qid, term, qtf FROM qterms"))
def s4(c: Cell) -> DataFrame:
    from verdictlab.sources.retrieval import query_terms

    return query_terms(c.topics)


@query("s3_term_statistics", S.sql("SELECT term, df, round(idf, 6) AS idf FROM idf"))
def s3(c: Cell) -> DataFrame:
    from verdictlab.sources.retrieval import query_terms

    return c.index.idf().join(F.broadcast(query_terms(c.topics).select("term").distinct()), "term", "left_semi").select("term", "df", F.round("idf", 6).alias("idf"))


@query("g1_pairs_top_k", S.sql("SELECT * FROM pairs"))
def g1(c: Cell) -> DataFrame:
    return pairs.sample_pairs(c.pool, "top_k_all_pairs", k=10)


_UNIFORM = "SELECT qid, doc_id_1, doc_id_2 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY md5('42-' || qid || '-' || doc_id_1 || '-' || doc_id_2), doc_id_1, doc_id_2) AS n FROM (SELECT a.qid, least(a.docno, b.docno) AS doc_id_1, greatest(a.docno, b.docno) AS doc_id_2 FROM pool a JOIN pool b ON a.qid = b.qid AND a.rank < b.rank)) WHERE n <= 50"


@query("g1_pairs_uniform", S.sql(_UNIFORM))
def g1_uniform(c: Cell) -> DataFrame:
    return pairs.sample_pairs(c.pool, "uniform", per_query=50, seed=42)


_ROUND = "query_id, doc_id_a, doc_id_b, verdict, round(prob_a, 6) AS prob_a, round(score_a, 6) AS score_a, round(score_b, 6) AS score_b"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("query_id", "doc_id_a", "doc_id_b", "verdict", *[F.round(x, 6).alias(x) for x in ("prob_a", "score_a", "score_b")])


@query("r2_mock_verdicts", S.sql(f"SELECT {_ROUND} FROM plain"))
def r2(c: Cell) -> DataFrame:
    return _rounded(pairs.mock_verdicts(pairs.presentations(c.pairs), c.topics, c.corpus))


@query("r6_presentations", S.sql("SELECT * FROM shown"))
def r6(c: Cell) -> DataFrame:
    return pairs.presentations(c.pairs)


@query("r7_missing_presentations", S.sql("SELECT * FROM shown WHERE (qid, doc_a, doc_b) NOT IN (SELECT (query_id, doc_id_a, doc_id_b) FROM stored WHERE doc_id_a < doc_id_b AND verdict <> 'tie')"))
def r7(c: Cell) -> DataFrame:
    return pairs.missing_presentations(pairs.presentations(c.pairs), c.stored.filter("doc_id_a < doc_id_b AND verdict <> 'tie'"))


@query("j19_wanted_rows", S.sql(f"SELECT {_ROUND} FROM stored WHERE (query_id, least(doc_id_a, doc_id_b), greatest(doc_id_a, doc_id_b)) IN (SELECT (qid, doc_id_1, doc_id_2) FROM wanted_other)"))
def j19(c: Cell) -> DataFrame:
    """The stored verdicts on the pairs of another run."""
    return _rounded(pairs.wanted_rows(c.stored, pairs.top_k_pairs(c.copeland, 6)))


@query("a1_collapse_verdicts", S.sql("SELECT * FROM verdicts"))
def a1(c: Cell) -> DataFrame:
    return c.verdicts


@query("a2_consistency", S.sql("SELECT count(*) AS n_pairs, count(*) FILTER (n_presentations >= 2) AS n_both_orders, round(avg(CAST(position_consistent AS INTEGER)), 6) AS position_consistency, round(avg(CAST(model_pref <> 0 AS INTEGER)), 6) AS decisive_rate, count(*) FILTER (collapse_reason = 'decisive') AS n_decisive, count(*) FILTER (collapse_reason = 'model_tie') AS n_model_tie, count(*) FILTER (collapse_reason = 'order_disagreement') AS n_order_disagreement FROM verdicts"))
def a2(c: Cell) -> DataFrame:
    return pairs.consistency_stats(c.verdicts)


@query("a6_transitivity", S.sql("SELECT n_triangles_sampled, n_complete_triangles, n_cyclic, round(CASE WHEN n_triangles_sampled > 0 THEN n_complete_triangles / n_triangles_sampled END, 6) AS triangle_survival, round(CASE WHEN n_complete_triangles > 0 THEN n_cyclic / n_complete_triangles END, 6) AS nontransitivity_rate FROM (SELECT count(*) AS n_triangles_sampled, count(*) FILTER (a * b * c <> 0) AS n_complete_triangles, count(*) FILTER (a * b * c <> 0 AND (a > 0)::INT + (b > 0)::INT = 1 AND (a < 0)::INT + (c > 0)::INT = 1) AS n_cyclic FROM (SELECT x.model_pref AS a, y.model_pref AS b, z.model_pref AS c FROM verdicts x JOIN verdicts y ON x.query_id = y.query_id AND x.doc_id_1 = y.doc_id_1 JOIN verdicts z ON z.query_id = x.query_id AND z.doc_id_1 = x.doc_id_2 AND z.doc_id_2 = y.doc_id_2))"))
def a6(c: Cell) -> DataFrame:
    return pairs.triangles(c.verdicts)


@query("g2_copeland", S.sql("SELECT * FROM copeland"))
def g2(c: Cell) -> DataFrame:
    return c.copeland


_BLOCK = "SELECT p.qid, p.docno, CAST(row_number() OVER w - 1 AS INTEGER) AS rank, CAST(1 - row_number() OVER w AS DOUBLE) AS score FROM (SELECT p.*, {s} AS s FROM pool p {join}) p WINDOW w AS (PARTITION BY p.qid ORDER BY (CASE WHEN rank < {depth} AND s IS NOT NULL THEN 0 ELSE 1 END), CASE WHEN rank < {depth} THEN s END DESC NULLS LAST, rank)"


@query("g4_rerank_scored", S.sql(_BLOCK.format(s="h.s", join="LEFT JOIN hashes h USING (qid, docno)", depth=10)))
def g4(c: Cell) -> DataFrame:
    from verdictlab.functions.text import hash_score

    top = c.pool.filter("rank < 10").join(c.topics, "qid").join(c.corpus, "docno")
    return ranking.rerank_scored(c.pool, top.select("qid", "docno", hash_score(F.col("query"), F.col("text")).alias("s")), 10)


@query("g5_oracle_rerank", S.sql(_BLOCK.format(s="coalesce(q.relevance, 0)", join="LEFT JOIN qrels q ON q.query_id = p.qid AND q.doc_id = p.docno", depth=50)))
def g5(c: Cell) -> DataFrame:
    return ranking.oracle_rerank(c.pool, c.qrels, 50)


@query("s6_qrels", S.sql("SELECT * FROM qrels"))
def s6(c: Cell) -> DataFrame:
    return c.qrels


@query("g7_metrics_bm25", S.sql("SELECT * FROM bm25_metrics"))
def g7(c: Cell) -> DataFrame:
    return ranking.evaluate(c.pool, c.qrels)


@query("g7_metrics_copeland", S.sql("SELECT * FROM copeland_metrics"))
def g7_copeland(c: Cell) -> DataFrame:
    return ranking.evaluate(c.copeland, c.qrels)


# ---- axioms


@query("x_axiom_preferences", S.sql("SELECT * FROM axioms"))
def x_axioms(c: Cell) -> DataFrame:
    from verdictlab.operators.axioms import axiom_preferences

    return axiom_preferences(c.pool, c.pairs, c.topics, c.corpus, index=c.index)


@query("x23_semantic_axioms", S.sql(S.SEMANTIC))
def x_semantic(c: Cell) -> DataFrame:
    from verdictlab.operators.axioms import semantic_preferences

    return semantic_preferences(c.pool, c.pairs, c.topics, c.corpus, c.index)


# ---- agreement


def judged(c: Cell) -> DataFrame:
    """Decisive pairs with their covariates; what BM25's order predicts stands for a model's predictions."""
    from verdictlab.operators import analysis

    right = F.signum(F.col("rank_2") - F.col("rank_1")) == F.col("model_pref")
    rows = analysis.attach_pool(c.merged, c.pool, "score")
    return rows.filter("model_pref <> 0").select(*analysis.KEY, (F.col("model_pref") > 0).alias("y_true"), right.alias("oof_correct"), (F.col("rank_2") - F.col("rank_1")).alias("margin"), "score_1", "score_2").join(c.covariates, analysis.KEY)


@query("j1_merged_pairs", S.sql("SELECT query_id, doc_id_1, doc_id_2, model_pref, n_presentations, position_consistent, collapse_reason, " + ", ".join(f'"{n}"' for n in S.USED) + ", CAST(rank_1 AS INTEGER) AS rank_1, CAST(rank_2 AS INTEGER) AS rank_2, CAST(rank_gap AS INTEGER) AS rank_gap FROM merged"))
def j1(c: Cell) -> DataFrame:
    return c.merged


@query("a3_agreement", S.sql("SELECT * FROM agreement"))
def a3(c: Cell) -> DataFrame:
    from verdictlab.operators.analysis import agreement_table

    return agreement_table(c.merged, S.USED)


@query("a5_agreement_intervals", S.sql("SELECT * FROM intervals"))
def a5(c: Cell) -> DataFrame:
    from verdictlab.operators.analysis import agreement_intervals

    return agreement_intervals(c.merged, S.USED)


@query("d10_covariates", S.sql("SELECT * FROM covariates"))
def d10(c: Cell) -> DataFrame:
    return c.covariates


@query("a8_gap_gradient", S.sql("SELECT * FROM gradient"))
def a8(c: Cell) -> DataFrame:
    from verdictlab.operators.analysis import gap_gradient

    return gap_gradient(c.merged, S.USED, bins=4, max_integer=3)


PROFILED = ["rank_gap", "d_score", "len_ratio", "query_len", "conf_margin_prob"]


@query("a9_residual_profiles", S.sql(" UNION ALL ".join(f"({S.profile(n)})" for n in PROFILED)))
def a9(c: Cell) -> DataFrame:
    from verdictlab.operators.analysis import profiles

    return profiles(judged(c), PROFILED)


@query("m16_auc", S.sql("SELECT count(*) FILTER (y_true) AS n_positive, count(*) FILTER (NOT y_true) AS n_negative, round((sum(r) FILTER (y_true) - count(*) FILTER (y_true) * (count(*) FILTER (y_true) + 1) / 2) / (count(*) FILTER (y_true) * count(*) FILTER (NOT y_true)), 6) AS auc FROM (SELECT y_true, rank() OVER (ORDER BY margin) + (count(*) OVER (PARTITION BY margin) - 1) / 2 AS r FROM judged)"))
def m16(c: Cell) -> DataFrame:
    from verdictlab.operators.analysis import auc

    return auc(judged(c), "margin", "y_true")


@query("m7_information", S.sql(f"SELECT n, round(a, 6) AS null_log_loss, round(b, 6) AS model_log_loss, round(a - b, 6) AS gain, round(CASE WHEN a > 0 THEN 1 - b / a END, 6) AS pseudo_r2 FROM (SELECT count(*) AS n, {S.entropy('y_true', 'base')} AS a, {S.entropy('y_true', 'p')} AS b FROM (SELECT y_true, 1 / (1 + exp(-margin / 10)) AS p, avg(CAST(y_true AS INTEGER)) OVER () AS base FROM judged))"))
def m7(c: Cell) -> DataFrame:
    from verdictlab.operators.analysis import information

    j = staged(judged(c), "judged")
    base = j.agg(F.avg(F.col("y_true").cast("int"))).first()[0]
    return information(j.select("y_true", (1 / (1 + F.exp(-F.col("margin") / 10))).alias("p"), F.lit(base).alias("base")), "y_true", "p", "base")


@query("m8_sensitivity", S.sql("SELECT query_id, round(CASE WHEN x IS NULL THEN NULL WHEN x <= 0.5 THEN 0.5 ELSE 0.5 * (1 + sqrt(2 * x - 1)) END, 6) AS sensitivity FROM (SELECT query_id, avg(CAST(position_consistent AS INTEGER)) AS x FROM verdicts GROUP BY query_id)"))
def m8(c: Cell) -> DataFrame:
    from verdictlab.operators.analysis import single_order_sensitivity

    return c.verdicts.groupBy("query_id").agg(F.avg(F.col("position_consistent").cast("int")).alias("x")).select("query_id", F.round(single_order_sensitivity(F.col("x")), 6).alias("sensitivity"))


@query("m15_regression_fidelity", S.sql("SELECT count(*) AS n, round(corr(rs, rp), 6) AS spearman, round(avg(abs(score_1 - score_2)), 6) AS mae, round(1 - sum((score_1 - score_2) * (score_1 - score_2)) / (var_pop(score_1) * count(*)), 6) AS r2 FROM (SELECT score_1, score_2, rank() OVER (ORDER BY score_1) + (count(*) OVER (PARTITION BY score_1) - 1) / 2 AS rs, rank() OVER (ORDER BY score_2) + (count(*) OVER (PARTITION BY score_2) - 1) / 2 AS rp FROM judged)"))
def m15(c: Cell) -> DataFrame:
    from verdictlab.operators.analysis import regression_fidelity

    return regression_fidelity(judged(c), "score_1", "score_2")


@query("g10_bm25_predictor", S.sql("SELECT query_id, count(*) AS n, round(avg(CAST(oof_correct AS INTEGER)), 6) AS accuracy FROM judged GROUP BY query_id"))
def g10(c: Cell) -> DataFrame:
    return judged(c).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.avg(F.col("oof_correct").cast("int")), 6).alias("accuracy"))


# ---- intents and answers


@query("q1_query_intents", S.sql("SELECT qid, intent, array_to_string(anchors, ' ') AS anchors, numeric_type, numeric_unit FROM intents"))
def q1(c: Cell) -> DataFrame:
    from verdictlab.functions.intent import normal, parse_query

    f = c.topics.select("qid", parse_query(normal(F.col("query"))).alias("f"))
    return f.select("qid", "f.intent", F.array_join("f.anchors", " ").alias("anchors"), "f.numeric_type", "f.numeric_unit")


@query("q9_boilerplate", S.sql("SELECT * FROM stock"))
def q9(c: Cell) -> DataFrame:
    from verdictlab.functions.intent import boilerplate_score
    from verdictlab.functions.text import sentences

    return c.corpus.select("docno", boilerplate_score(F.col("text"), sentences(F.col("text"))).alias("boilerplate"))


@query("f5_sentences", S.sql("SELECT docno, CAST(len(ss) AS INTEGER) AS n_sentences, md5(array_to_string(ss, '|')) AS digest FROM split"))
def f5(c: Cell) -> DataFrame:
    from verdictlab.functions.text import sentences

    s = sentences(F.col("text"))
    return c.corpus.select("docno", F.size(s).alias("n_sentences"), F.md5(F.array_join(s, "|")).alias("digest"))


#: What is put behind a passage, by a hash of query and document: @ stands for the query's last word but one, * for all its words. Without them these texts answer nothing.
ADDED = ("@ is a very small thing.", "@ is found here.", "@ means nothing new today.", "There are 12 @ and ten more.", "It costs $5 for @. They say @ takes 3 hours.", "* differ while others are the same.", "Click here. Contact us at www.x.org 1. again", "")


def _answering(c: Cell) -> DataFrame:
    """The documents of pairs with a sentence that may answer."""
    from verdictlab.functions.text import tokens

    used = c.pairs.select("qid", F.col("doc_id_1").alias("docno")).union(c.pairs.select("qid", F.col("doc_id_2").alias("docno"))).distinct()
    docs = pairs.with_texts(used, c.topics, c.corpus)
    words = tokens(F.col("query"))
    pick = F.get(F.array(*map(F.lit, ADDED)), F.floor(F.conv(F.substring(F.md5(F.concat_ws("-", "docno", "qid")), 1, 1), 16, 10).cast("int") / 2).cast("int"))
    added = F.replace(F.replace(pick, F.lit("@"), F.coalesce(F.try_element_at(words, F.lit(-2)), F.lit(""))), F.lit("*"), F.array_join(words, " "))
    return staged(docs.select("qid", "docno", "query", F.concat("text", F.lit("\n"), added).alias("text")), "answering")


@query("x7_answer_axioms", S.sql(S.answer_preferences(), **S.answers(ADDED)))
def x7(c: Cell) -> DataFrame:
    from verdictlab.operators.answers import answer_preferences, evidence_of

    return answer_preferences(c.pairs, c.topics, found=evidence_of(_answering(c)))


@query("q4_answer_evidence", S.sql("SELECT qid, docno, cov, definition, numeric, comparison, boilerplate FROM answer_evidence", **S.answers(ADDED)))
def q4(c: Cell) -> DataFrame:
    from verdictlab.operators.answers import evidence_of

    return evidence_of(_answering(c))


# ---- store, gates, decoding


@query("s5_first_write", S.sql("SELECT query_id, doc_id_a, doc_id_b, prompt_version, verdict, created_at, round(prob_a, 6) AS prob_a FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id_a, doc_id_b ORDER BY created_at) AS n FROM writes) WHERE n = 1"))
def s5(c: Cell) -> DataFrame:
    """Two writes to the store, and what a reader finds."""
    from verdictlab.sources import store

    path, rows = fresh(c.spark, "store"), _writes(c)
    for biased in (True, False):
        store.append(rows.filter(F.col("biased") == biased).withColumns({"dataset": F.lit("d"), "model": F.lit("mock"), "latency_ms": F.lit(None).cast("double")}), path)
    return store.load(c.spark, path, dataset="d").select("query_id", "doc_id_a", "doc_id_b", "prompt_version", "verdict", "created_at", F.round("prob_a", 6).alias("prob_a"))


@query("w4_last_write", S.sql("SELECT query_id, doc_id_a, doc_id_b, prompt_version, verdict, created_at, round(prob_a, 6) AS prob_a FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id_a, doc_id_b ORDER BY created_at DESC) AS n FROM writes) WHERE n = 1"))
def w4(c: Cell) -> DataFrame:
    from verdictlab.sources.store import keep_one

    return keep_one(_writes(c), ["query_id", "doc_id_a", "doc_id_b", "prompt_version"], F.desc("created_at")).select("query_id", "doc_id_a", "doc_id_b", "prompt_version", "verdict", "created_at", F.round("prob_a", 6).alias("prob_a"))


def _writes(c: Cell) -> DataFrame:
    plain = pairs.mock_verdicts(pairs.presentations(c.pairs), c.topics, c.corpus).withColumns({"created_at": F.lit("2024-01-02"), "biased": F.lit(False)})
    rows = c.stored.withColumns({"created_at": F.when(F.substring("doc_id_a", 8, 1) < "5", "2024-01-01").otherwise("2024-01-03"), "biased": F.lit(True)})
    return rows.unionByName(plain).withColumn("prompt_version", F.lit("v0"))


@query("s16_pool_documents", S.sql("SELECT qid, docno, md5(query) AS query, md5(text) AS text FROM (SELECT DISTINCT qid, docno FROM pool WHERE rank < 20 UNION SELECT qid, doc_id_1 FROM pairs UNION SELECT qid, doc_id_2 FROM pairs) JOIN topics USING (qid) JOIN corpus USING (docno)"))
def s16(c: Cell) -> DataFrame:
    return pairs.pool_documents(c.pool, c.pairs, c.topics, c.corpus, 20).withColumns({x: F.md5(x) for x in ("query", "text")})


@query("s15_pooled_collections", f"SELECT collection, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens, max(n) AS longest FROM (SELECT 'documents' AS collection, len(regexp_extract_all(lower(coalesce(text, '')), '{S.W}')) AS n FROM documents UNION ALL SELECT 'conversations', len(regexp_extract_all(lower(coalesce(text, '')), '{S.W}')) FROM conversations) GROUP BY collection")
def s15(c: Cell) -> DataFrame:
    from verdictlab.functions.text import tokens

    one = lambda t: c.spark.read.parquet(f"{c.dir}/{t}.parquet").select(F.lit(t).alias("collection"), F.size(tokens(F.coalesce("text", F.lit("")))).cast("long").alias("n"))
    return one("documents").unionByName(one("conversations")).groupBy("collection").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"), F.max("n").alias("longest"))


def _signals():
    from verdictlab.functions.text import hash_score
    from verdictlab.operators.axioms import similarity

    best = lambda constraint, words: F.coalesce(F.array_max(F.transform(words, lambda w: similarity(constraint, w))), F.lit(0.0))
    return hash_score, hash_score, best


def _asked(c: Cell) -> DataFrame:
    """The topics; every other one asks for its second word as a constraint."""
    from verdictlab.functions.text import tokens

    second = F.get(tokens(F.col("query")), F.lit(1))
    return c.topics.select("qid", F.when((F.col("qid").cast("int") % 2 == 0) & second.isNotNull(), F.concat("query", F.lit(" lang:"), second)).otherwise(F.col("query")).alias("query"))


_GATES = ["qid", "docno", "score", "relevant", "answers", "constrained", "relevance", "entailment", "similarity"]


def _gates(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(x, 6).alias(x) if x in ("relevance", "entailment", "similarity") else F.col(x) for x in _GATES])


@query("z3_gates", S.sql("SELECT * FROM gates"))
def z3(c: Cell) -> DataFrame:
    from verdictlab.operators.gates import gated

    docs = c.pool.filter("rank < 10").join(_asked(c), "qid").join(c.corpus, "docno").select("qid", "query", "docno", "text")
    return _gates(gated(docs, *_signals(), html=False))


@query("z7_resumed_scores", S.sql("SELECT * FROM gates"))
def z7(c: Cell) -> DataFrame:
    """The gates' scores of a pool whose first half was scored by a run that stopped."""
    from verdictlab.operators.distil import score_pool

    path = fresh(c.spark, "scores")
    args = (_asked(c), c.corpus, path, *_signals())
    score_pool(c.pool, *args, depth=5, html=False, parts=1)
    return _gates(score_pool(c.pool, *args, depth=10, html=False, parts=2))


@query("z3_gates_of_pages")
def z3_pages(c: Cell) -> DataFrame:
    """The gates over web pages, whose prose is read first: each page is asked for its own title."""
    from verdictlab.operators.gates import gated

    pages = c.spark.read.parquet(f"{c.dir}/pages.parquet")
    asked = F.concat(F.coalesce(F.nullif(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1), F.lit("")), "url", F.lit("")), F.lit(" lang:en"))
    docs = pages.select(F.lit("pages").alias("qid"), asked.alias("query"), F.col("page_id").cast("string").alias("docno"), F.coalesce("html", F.lit("")).alias("text"))
    return gated(docs, *_signals()).groupBy("score").agg(F.count("*").alias("n"))


@query("a15_score_distribution", S.sql("SELECT score, count(*) AS n FROM gates GROUP BY score"))
def a15(c: Cell) -> DataFrame:
    from verdictlab.operators.analysis import distribution

    return distribution(z3(c), "score")


def _distil(c: Cell) -> DataFrame:
    from verdictlab.operators.distil import features

    score, entails, _ = _signals()
    return features(c.pool, c.topics, c.corpus, score, entails, lambda q, passage: score(passage, q), depth=10, html=False)


def _graded(c: Cell) -> DataFrame:
    """Features with an adequacy of one and a half a grade, where there is a judgement."""
    from verdictlab.operators.distil import labelled

    grade = F.col("relevance") * 1.5
    labels = c.qrels.select(F.col("query_id").alias("qid"), F.col("doc_id").alias("docno"), grade.alias("adequacy"), F.round(grade).cast("int").alias("argmax"))
    return labelled(_distil(c), labels, "adequacy", "argmax")


@query("z8_distil_features", S.sql("SELECT qid, docno, " + ", ".join(f"round({x}, 6) AS {x}" for x in ("bm25_score", "bm25_rank", "log_length", "query_coverage", "relevance_probability", "nli_entailment", "mrc_margin")) + " FROM distil"))
def z8(c: Cell) -> DataFrame:
    from verdictlab.operators.distil import BASE, SIGNALS

    return _distil(c).select("qid", "docno", *[F.round(x, 6).alias(x) for x in (*BASE, *SIGNALS)])


_DIAGNOSED = "count(*) AS n_documents, count(*) FILTER (adequacy >= 2.5) AS n_high, round(avg(CAST(relevance_probability < 0.4 AS INTEGER)) FILTER (adequacy >= 2.5), 6) AS relevance_false_negative_rate, round(avg(CAST(nli_entailment < 0.65 AS INTEGER)) FILTER (adequacy >= 2.5), 6) AS nli_false_negative_rate, " + ", ".join(f"round(avg({x}), 6) AS mean_{x}" for x in ("relevance_probability", "nli_entailment", "mrc_margin"))


@query("a13_gate_diagnostics", S.sql(f"SELECT argmax, {_DIAGNOSED} FROM graded WHERE adequacy IS NOT NULL GROUP BY argmax UNION ALL SELECT NULL, {_DIAGNOSED} FROM graded WHERE adequacy IS NOT NULL"))
def a13(c: Cell) -> DataFrame:
    from verdictlab.operators.distil import gate_diagnostics

    return gate_diagnostics(_graded(c))


@query("j18_unscored_documents", S.sql("SELECT qid, docno FROM pool WHERE rank < 20 AND (qid, docno) NOT IN (SELECT (query_id, doc_id) FROM qrels)"))
def j18(c: Cell) -> DataFrame:
    from verdictlab.operators.distil import unscored

    return unscored(c.pool.filter("rank < 20").select("qid", "docno"), c.qrels.select(F.col("query_id").alias("qid"), F.col("doc_id").alias("docno")))


@query("m13_transfer")
def m13(c: Cell) -> DataFrame:
    """The fit on the documents of even ranks, applied as it is to those of odd ranks."""
    from verdictlab.operators.distil import BASE, SIGNALS, transfer

    frame = staged(_graded(c), "graded")
    return transfer(frame.filter("bm25_rank % 2 = 0"), frame.filter("bm25_rank % 2 = 1"), BASE + SIGNALS)[0].select("qid", "docno", F.round("predicted", 6).alias("predicted"))


@query("m14_adaptation")
def m14(c: Cell) -> DataFrame:
    from verdictlab.operators.distil import BASE, SIGNALS, adapted

    frame = staged(_graded(c).fillna(0.0, ["adequacy"]), "graded")
    return adapted(frame, BASE + SIGNALS, max(1, frame.select("qid").distinct().count() // 3)).select("qid", "docno", F.round("predicted", 6).alias("predicted"))


@query("r7_collected_verdicts", S.sql(f"SELECT {_ROUND} FROM plain"))
def r7_collected(c: Cell) -> DataFrame:
    """All verdicts of the mock ranker, after a collection that stopped at the pairs of the five best."""
    from verdictlab.operators.rankers import collect_verdicts
    from verdictlab.sources.config import Ranker

    path = fresh(c.spark, "verdicts")
    collect_verdicts("d", Ranker(max_chars=10**9), pairs.top_k_pairs(c.pool, 5), c.topics, c.corpus, path)
    return _rounded(collect_verdicts("d", Ranker(max_chars=10**9), c.pairs, c.topics, c.corpus, path))


@query("g14_measured_cell", S.sql("SELECT * FROM intervals"))
def g14(c: Cell) -> DataFrame:
    """The report's agreement table over the verdicts of the cell, with its fits and gradient made beside it."""
    from verdictlab.plans.measurement import feature_set, measured

    return measured(c, c.stored, {"all": feature_set(c.merged, c.axiom_names)}, "all")["agreement"]


@query("a23_tie_diagnostics", S.sql("SELECT count(*) FILTER (model_pref = 0) AS target_ties, count(*) FILTER (model_pref <> 0) AS target_decisive, count(*) FILTER (pred = 0) AS vote_ties, count(*) FILTER (pred <> 0) AS vote_decisions, " + ", ".join(f"count(*) FILTER (collapse_reason = '{r}') AS n_{r}" for r in ("decisive", "model_tie", "order_disagreement")) + " FROM voted"))
def a23(c: Cell) -> DataFrame:
    from verdictlab.operators.analysis import tie_diagnostics
    from verdictlab.operators.axioms import majority

    return tie_diagnostics(c.merged, majority(S.USED))


def _entries(c: Cell) -> DataFrame:
    pair = lambda t, x: F.struct(F.lit(t).alias("token"), x.alias("logprob"))
    a, b = F.log(F.col("score_a") + 0.01), F.log(F.col("score_b") + 0.01)
    entries = F.array(pair("A", a), pair("x", F.lit(0.0)), F.when(F.col("verdict") == "a", pair(" a", F.log(F.col("score_a") + 0.02))), F.when(F.col("verdict") != "tie", pair("b ", b)))
    return c.stored.select("query_id", "doc_id_a", "doc_id_b", F.filter(entries, lambda e: e.isNotNull()).alias("entries"))


@query("r4_label_verdicts", S.sql("SELECT query_id, doc_id_a, doc_id_b, CASE WHEN b IS NULL OR a > b THEN 'a' WHEN a < b THEN 'b' ELSE 'tie' END AS verdict, round(CASE WHEN b IS NULL THEN 1.0 ELSE 1 / (1 + exp(b - a)) END, 6) AS prob_a FROM answers"))
def r4(c: Cell) -> DataFrame:
    from verdictlab.operators.gates import label_verdict

    return _entries(c).select("query_id", "doc_id_a", "doc_id_b", label_verdict(F.col("entries")).alias("v")).select("query_id", "doc_id_a", "doc_id_b", "v.verdict", F.round("v.prob_a", 6).alias("prob_a"))


@query("r5_adequacy", S.sql("SELECT query_id, doc_id_a, doc_id_b, round((p1 + 3 * p3) / (p1 + p3), 6) AS adequacy, CASE WHEN p1 >= p3 THEN 1 ELSE 3 END AS argmax, CASE WHEN b1 IS NULL THEN 1 ELSE 2 END AS n_label_logprobs FROM (SELECT *, exp(a1) AS p1, coalesce(exp(b1), 0) AS p3 FROM logprobs)"))
def r5(c: Cell) -> DataFrame:
    from verdictlab.operators.gates import adequacy

    digits = F.transform(F.filter("entries", lambda e: e["token"].isin("A", "b ")), lambda e: F.struct(F.when(e["token"] == "A", " 1").otherwise("3").alias("token"), e["logprob"].alias("logprob")))
    return _entries(c).select("query_id", "doc_id_a", "doc_id_b", adequacy(digits).alias("v")).select("query_id", "doc_id_a", "doc_id_b", F.round("v.adequacy", 6).alias("adequacy"), "v.argmax", "v.n_label_logprobs")


@query("f8_clean_pages")
def f8(c: Cell) -> DataFrame:
    from verdictlab.functions.markup import clean_passage

    return c.spark.read.parquet(f"{c.dir}/pages.parquet").select("page_id", clean_passage("html").alias("passage"))


@query("f9_prepared_queries", S.sql("SELECT qid, query || ' in Python' AS text, 'python|docs.example' AS constraints FROM topics"))
def f9(c: Cell) -> DataFrame:
    from verdictlab.functions.markup import prepared_query

    asked = c.topics.withColumn("query", F.concat("query", F.lit(" in Python lang:python site:docs.example")))
    return asked.select("qid", prepared_query(F.col("query")).alias("p")).select("qid", "p.text", F.array_join("p.constraints", "|").alias("constraints"))


# ---- models and runs


@query("m1_query_folds", S.sql(f"SELECT * FROM ({S.folds('verdicts')})"))
def m1(c: Cell) -> DataFrame:
    from verdictlab.operators.models import assign_folds

    return assign_folds(c.verdicts)


@query("m3_joint_fit")
def m3(c: Cell) -> DataFrame:
    from verdictlab.operators.models import joint_fit

    return joint_fit(c.merged, S.USED)[0]


@query("m4_surrogate")
def m4(c: Cell) -> DataFrame:
    from verdictlab.operators.models import surrogate

    return surrogate(c.merged, S.USED)[0]


@query("a12_surrogate_fidelity")
def a12(c: Cell) -> DataFrame:
    from verdictlab.operators.models import fidelity, surrogate

    return fidelity(surrogate(c.merged, S.USED)[0])


@query("a20_feature_zero")
def a20(c: Cell) -> DataFrame:
    from verdictlab.operators.models import feature_zero_effect, surrogate

    predicted, found = surrogate(c.merged, S.USED)
    return feature_zero_effect(predicted, S.USED, found["fits"])


@query("m3_two_axioms", S.sql("SELECT query_id, doc_id_1, doc_id_2, fold, t AS y_true, round(p, 6) AS oof_prob, ok AS oof_correct, round(q, 6) AS oof_null_prob, null_ok AS oof_null_correct, vote_ok AS vote_correct FROM joint_right"))
def m3_two(c: Cell) -> DataFrame:
    """The fit of two axioms, which SQL can follow step by step."""
    from verdictlab.operators.models import joint_fit

    return joint_fit(c.merged, list(S.FIT))[0].withColumns({x: F.round(x, 6) for x in ("oof_prob", "oof_null_prob")})


@query("m4_two_axioms", S.sql(f'SELECT query_id, doc_id_1, doc_id_2, fold, model_pref AS target_pref, x1 AS "{S.FIT[0]}", x2 AS "{S.FIT[1]}", round(p, 6) AS surrogate_prob, pref AS surrogate_pref, CASE WHEN model_pref <> 0 THEN pref = model_pref END AS correct_on_decisive FROM surrogates'))
def m4_two(c: Cell) -> DataFrame:
    from verdictlab.operators.models import surrogate

    return surrogate(c.merged, list(S.FIT))[0].withColumn("surrogate_prob", F.round("surrogate_prob", 6))


@query("a12_fidelity_of_two", S.sql(f"SELECT CAST(sum(pairs) AS BIGINT) AS n_pairs, count(*) AS n_queries, CAST(sum(n) AS BIGINT) AS n_decisive, round(sum(good) / sum(n), 6) AS accuracy, round(avg(macro), 6) AS query_macro_accuracy, round(sum(loss) / sum(n), 6) AS log_loss, CAST(sum(ties) AS BIGINT) AS n_ties, CAST(sum(own) AS BIGINT) AS n_surrogate_ties, CAST(sum(forced) AS BIGINT) AS n_forced, {S.area('p', 'y = 1', '(SELECT * FROM surrogates WHERE model_pref <> 0)')} AS auc FROM surrogate_queries"))
def a12_two(c: Cell) -> DataFrame:
    from verdictlab.operators.models import fidelity, surrogate

    return fidelity(surrogate(c.merged, list(S.FIT))[0])


@query("a20_zero_of_two", S.sql(" UNION ALL ".join(f"SELECT '{f}' AS feature, count(*) FILTER (without_{i} <> pref) AS pairs, count(DISTINCT query_id) FILTER (without_{i} <> pref) AS queries FROM surrogates" for i, f in enumerate(S.FIT, 1))))
def a20_two(c: Cell) -> DataFrame:
    from verdictlab.operators.models import feature_zero_effect, surrogate

    predicted, found = surrogate(c.merged, list(S.FIT))
    return feature_zero_effect(predicted, list(S.FIT), found["fits"])


@query("m6_decomposition_of_two", S.sql(f"SELECT n_decisive_pairs, base_rate, cv_null_accuracy, majority_vote_accuracy, cv_accuracy, cv_auc, round(x, 6) AS null_log_loss, round(z, 6) AS model_log_loss, round(x - z, 6) AS gain, round(1 - z / x, 6) AS pseudo_r2, round(CASE WHEN consistency <= 0.5 THEN 0.5 ELSE 0.5 * (1 + sqrt(2 * consistency - 1)) END, 6) AS single_order_accuracy_sensitivity, round(1 - cv_accuracy, 6) AS oof_error_fraction, round(cv_accuracy - cv_null_accuracy, 6) AS accuracy_gain_over_base FROM (SELECT count(*) AS n_decisive_pairs, round(greatest(avg(y), 1 - avg(y)), 6) AS base_rate, round(avg(CAST(null_ok AS INTEGER)), 6) AS cv_null_accuracy, round(avg(CAST(vote_ok AS INTEGER)), 6) AS majority_vote_accuracy, round(avg(CAST(ok AS INTEGER)), 6) AS cv_accuracy, {S.area('p', 't', 'joint_oof')} AS cv_auc, {S.entropy('t', 'q')} AS x, {S.entropy('t', 'p')} AS z, (SELECT avg(CAST(position_consistent AS INTEGER)) FILTER (n_presentations >= 2) FROM merged) AS consistency FROM joint_right)"))
def m6_two(c: Cell) -> DataFrame:
    from verdictlab.operators.models import decompose

    return decompose(c.merged, list(S.FIT))[0]


@query("m6_decomposition")
def m6(c: Cell) -> DataFrame:
    from verdictlab.operators.models import decompose
    from verdictlab.plans.measurement import feature_set

    return decompose(c.merged, feature_set(c.merged, S.USED))[0]


@query("m10_residual_model")
def m10(c: Cell) -> DataFrame:
    from verdictlab.operators import analysis

    names = ["d_len", "d_qcov", "score_gap", "len_ratio", "query_len"]
    return analysis.residual_model(c.merged.join(c.covariates.select(*analysis.KEY, *names), analysis.KEY), S.USED, names)


@query("a10_residual_clusters")
def a10(c: Cell) -> DataFrame:
    from verdictlab.operators.models import residual_clusters

    return residual_clusters(judged(c).filter("NOT oof_correct"), ["d_len", "d_qcov", "score_gap", "len_ratio"])


@query("m12_ridge")
def m12(c: Cell) -> DataFrame:
    from verdictlab.operators.distil import BASE, distilled

    return distilled(_graded(c), BASE).select("qid", "docno", "fold", F.round("predicted", 6).alias("predicted"))


def _runs(c: Cell) -> dict[str, DataFrame]:
    from verdictlab.operators.axioms import majority

    vote = c.merged.withColumn("model_pref", majority(S.USED))
    runs = {"bm25": c.pool, "llm": c.copeland, "oracle": ranking.oracle_rerank(c.pool, c.qrels, 50), "vote": ranking.copeland(vote, c.pool)}
    return {name: staged(ranking.evaluate(run, c.qrels), f"metrics-{name}") for name, run in runs.items()}


@query("g12_run_means", S.sql("SELECT run, count(*) AS n_queries, round(avg(ndcg_10), 6) AS ndcg_10, round(avg(ap), 6) AS ap FROM run_metrics GROUP BY run"))
def g12(c: Cell) -> DataFrame:
    from verdictlab.operators.reversals import run_means

    return run_means(_runs(c))


_RUNS = {"bm25": "bm25_metrics", "llm": "copeland_metrics", "oracle": "oracle_metrics", "vote": "vote_metrics"}
_CONTRASTS = ranking.contrasts_of(["oracle", "vote"], "oracle", "llm")


@query("g12_comparison_matrix", S.sql(" UNION ALL ".join(f"(SELECT '{name}' AS contrast, * FROM ({S.comparison(_RUNS[a], _RUNS[b])}))" for name, a, b in _CONTRASTS)))
def g12_matrix(c: Cell) -> DataFrame:
    return ranking.comparison_matrix(_runs(c), _CONTRASTS)


@query("g13_variant_profiles", S.sql(" UNION ALL ".join(f"(SELECT '{v}' AS variant, * FROM ({S.profile(n, source=t)}))" for v, t in (("bm25", "judged"), ("vote", "judged_vote")) for n in ("d_len", "d_qcov", "rank_gap"))))
def g13(c: Cell) -> DataFrame:
    """What the first stage's order and the axioms' vote get wrong, by covariate."""
    from verdictlab.operators import analysis
    from verdictlab.operators.axioms import majority

    decisive = c.merged.filter("model_pref <> 0").withColumn("y_true", F.col("model_pref") > 0)
    right = {"bm25": F.signum(F.col("rank_2") - F.col("rank_1")).cast("int"), "vote": majority(S.USED)}
    made = {v: staged(decisive.select(*analysis.KEY, "y_true", (p == F.col("model_pref")).alias("oof_correct")), v) for v, p in right.items()}
    return analysis.variant_profiles(made, c.covariates, ["d_len", "d_qcov", "rank_gap"])


@query("a24_metric_by_run", S.sql("SELECT query_id, " + ", ".join(f"max(ndcg_10) FILTER (run = '{r}') AS {r}" for r in ("bm25", "llm", "oracle", "vote")) + " FROM run_metrics GROUP BY query_id"))
def a24(c: Cell) -> DataFrame:
    from verdictlab.operators.reversals import by_run

    return by_run(_runs(c), "ndcg_10")


@query("g6_vote_run", S.sql("SELECT qid, docno, CAST(rank AS INTEGER) AS rank, score FROM vote_run"))
def g6(c: Cell) -> DataFrame:
    from verdictlab.operators.axioms import majority

    return ranking.copeland(c.merged.withColumn("model_pref", majority(S.USED)), c.pool)


@query("g11_reversals", S.sql("SELECT * FROM reversed"))
def g11(c: Cell) -> DataFrame:
    from verdictlab.operators.axioms import majority
    from verdictlab.operators.reversals import reversals

    return reversals(c.merged.withColumn("pred", majority(S.USED)), S.USED, c.pool, c.copeland, c.qrels)


_ELIGIBLE = "query_id IN (SELECT qid FROM kinds WHERE intent <> 'unknown')"


@query("a11_candidate_agreement", S.sql(f"SELECT i.* REPLACE (CASE WHEN n_evaluable_queries >= 5 THEN ci_lo END AS ci_lo, CASE WHEN n_evaluable_queries >= 5 THEN ci_hi END AS ci_hi), n_active_queries, n_queries, n_eligible_queries, eligible_pair_coverage, n_positive, n_negative FROM intervals i JOIN (SELECT axiom, count(DISTINCT query_id) FILTER (pref <> 0) AS n_active_queries, count(DISTINCT query_id) AS n_queries, count(DISTINCT query_id) FILTER ({_ELIGIBLE}) AS n_eligible_queries, round(avg(CAST(pref <> 0 AS INTEGER)) FILTER ({_ELIGIBLE}), 6) AS eligible_pair_coverage, count(*) FILTER (pref > 0) AS n_positive, count(*) FILTER (pref < 0) AS n_negative FROM long GROUP BY axiom) USING (axiom)"))
def a11(c: Cell) -> DataFrame:
    from verdictlab.functions.intent import normal, parse_query
    from verdictlab.operators.analysis import candidate_agreement

    # staged, so that the long expression of the intent isn't copied into the plans above
    intents = staged(c.topics.select(F.col("qid").alias("query_id"), parse_query(normal(F.col("query")))["intent"].alias("intent")), "intents")
    asked = intents.filter("intent <> 'unknown'").select("query_id", F.explode(F.array(*map(F.lit, S.USED))).alias("axiom"))
    return candidate_agreement(c.merged, S.USED, asked)


@query("m23_incremental_fidelity", S.sql("SELECT measure, round(sum(v) / sum(n), 6) AS lift, any_value(ci_lo) AS ci_lo, any_value(ci_hi) AS ci_hi FROM lift_long JOIN lift_ci USING (measure) GROUP BY measure"))
def m23(c: Cell) -> DataFrame:
    from verdictlab.operators.analysis import incremental_fidelity

    return incremental_fidelity(_two_models(c), "p1", "p2")


def _two_models(c: Cell) -> DataFrame:
    return staged(judged(c).select("query_id", "y_true", (1 / (1 + F.exp(-(F.col("margin") - 2) / 10))).alias("p1"), (1 / (1 + F.exp(-F.col("margin") / 5))).alias("p2")), "two-models")


@query("m21_macro_lift", S.sql("SELECT measure, round(sum(v) / sum(n), 6) AS lift, any_value(ci_lo) AS ci_lo, any_value(ci_hi) AS ci_hi FROM macro_long JOIN macro_ci USING (measure) GROUP BY measure"))
def m21(c: Cell) -> DataFrame:
    from verdictlab.operators.analysis import incremental_fidelity

    return incremental_fidelity(_two_models(c), "p1", "p2", macro=True)


@query("a14_adequacy_evaluation", S.sql("SELECT count(*) AS n_pairs, count(*) FILTER (model_pref <> 0) AS n_decisive, round(count(*) FILTER (model_pref <> 0 AND abs(one - two) > 0.1) / count(*) FILTER (model_pref <> 0), 6) AS discriminating_coverage, round(count(*) FILTER (model_pref <> 0 AND abs(one - two) > 0.1 AND sign(one - two) = model_pref) / count(*) FILTER (model_pref <> 0 AND abs(one - two) > 0.1), 6) AS sign_agreement, (SELECT round((sum(r) FILTER (model_pref > 0) - count(*) FILTER (model_pref > 0) * (count(*) FILTER (model_pref > 0) + 1) / 2) / (count(*) FILTER (model_pref > 0) * count(*) FILTER (model_pref < 0)), 6) FROM (SELECT model_pref, rank() OVER (ORDER BY one - two) + (count(*) OVER (PARTITION BY one - two) - 1) / 2 AS r FROM clear WHERE model_pref <> 0)) AS auc FROM clear"))
def a14(c: Cell) -> DataFrame:
    from verdictlab.functions.text import hash_score
    from verdictlab.operators.analysis import adequacy_evaluation

    docs = c.pool.filter("rank < 10").join(c.topics, "qid").join(c.corpus, "docno").select(F.col("qid").alias("query_id"), "docno", hash_score(F.col("query"), F.col("text")).alias("s"))
    v = c.verdicts
    for side, name in (("1", "one"), ("2", "two")):
        v = v.join(docs.select("query_id", F.col("docno").alias(f"doc_id_{side}"), F.col("s").alias(name)), ["query_id", f"doc_id_{side}"])
    return adequacy_evaluation(v, "one", "two")
