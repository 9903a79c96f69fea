"""The frames of the queries in DuckDB's SQL, as named steps that a query can start from. Written apart from the Spark code, in long form."""

from __future__ import annotations

from verdictlab.operators.pairs import POSITION_BIAS, TIE_MARGIN
from verdictlab.sources.retrieval import K1, OPENINGS, B

W = "[a-z0-9]+"
_openings = ", ".join(f"'{o}'" for o in OPENINGS)
_words = f"list_slice(regexp_extract_all(lower(coalesce(text, '')), '{W}'), 1, 5)"
_join = lambda a, b: f"array_to_string(list_slice(w, {a}, {b}), ' ')"

STEPS: dict[str, str] = {
    "topics": f"SELECT lpad(CAST(item_id AS VARCHAR), 6, '0') AS qid, ([{_openings}])[item_id % 8 + 1] || CASE item_id % 8 WHEN 4 THEN {_join(1, 2)} || ' and ' || {_join(3, 4)} WHEN 6 THEN {_join(1, 2)} || ' mean' ELSE {_join(1, 5)} END AS query FROM (SELECT item_id, {_words} AS w FROM benchmark WHERE item_id IS NOT NULL)",
    "corpus": "SELECT lpad(CAST(doc_id AS VARCHAR), 8, '0') AS docno, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL",
    "lists": f"SELECT docno, regexp_extract_all(lower(text), '{W}') AS words FROM corpus",
    "lengths": "SELECT docno, len(words) AS dl, list_unique(words) AS n_unique FROM lists",
    "qterms": f"SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(regexp_extract_all(lower(query), '{W}')) AS term FROM topics) GROUP BY ALL",
    "postings": "SELECT docno, unnest(words) AS term, unnest(range(len(words))) AS pos FROM lists",
    "tf": "SELECT docno, term, count(*) AS tf, min(pos) AS first FROM postings WHERE term IN (SELECT term FROM qterms) GROUP BY ALL",
    "idf": "SELECT term, count(*) AS df, ln(1 + ((SELECT count(*) FROM corpus) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY term",
    "scores": f"SELECT qid, docno, round(sum(qtf * idf * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * dl / (SELECT avg(dl) FROM lengths)))), 6) AS score FROM tf JOIN idf USING (term) JOIN qterms USING (term) JOIN lengths USING (docno) GROUP BY ALL",
    "pool": "SELECT * FROM (SELECT qid, docno, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docno) - 1 AS rank, score FROM scores) WHERE rank < 100",
    "pairs": "SELECT a.qid, least(a.docno, b.docno) AS doc_id_1, greatest(a.docno, b.docno) AS doc_id_2 FROM pool a JOIN pool b ON a.qid = b.qid AND a.rank < b.rank AND b.rank < 10",
    "shown": "SELECT qid, doc_id_1 AS doc_a, doc_id_2 AS doc_b FROM pairs UNION ALL SELECT qid, doc_id_2, doc_id_1 FROM pairs",
    "hashes": "SELECT DISTINCT qid, docno, CAST(CAST('0x' || substr(sha256(query || chr(0) || text), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0 AS s FROM (SELECT qid, doc_a AS docno FROM shown UNION SELECT qid, doc_b FROM shown) JOIN topics USING (qid) JOIN corpus USING (docno)",
}
for _name, _bias, _tie in (("plain", 0.0, 0.0), ("stored", POSITION_BIAS, TIE_MARGIN)):
    STEPS[f"{_name}_scores"] = f"SELECT s.qid, doc_a, doc_b, a.s + {_bias} AS score_a, b.s AS score_b FROM shown s JOIN hashes a ON a.qid = s.qid AND a.docno = doc_a JOIN hashes b ON b.qid = s.qid AND b.docno = doc_b"
    STEPS[_name] = f"SELECT qid AS query_id, doc_a AS doc_id_a, doc_b AS doc_id_b, CASE WHEN abs(score_a - score_b) <= {_tie} THEN 'tie' WHEN score_a > score_b THEN 'a' ELSE 'b' END AS verdict, CASE WHEN abs(score_a - score_b) <= {_tie} OR score_a + score_b <= 0 THEN 0.5 ELSE score_a / (score_a + score_b) END AS prob_a, score_a, score_b FROM {_name}_scores"
STEPS |= {
    "signed": "SELECT query_id, least(doc_id_a, doc_id_b) AS doc_id_1, greatest(doc_id_a, doc_id_b) AS doc_id_2, CASE verdict WHEN 'a' THEN 1 WHEN 'b' THEN -1 ELSE 0 END * CASE WHEN doc_id_b < doc_id_a THEN -1 ELSE 1 END AS pref FROM stored",
    "verdicts": "SELECT query_id, doc_id_1, doc_id_2, CAST(CASE WHEN min(pref) = max(pref) THEN min(pref) ELSE 0 END AS INTEGER) AS model_pref, CAST(count(*) AS INTEGER) AS n_presentations, CASE WHEN count(*) > 1 THEN min(pref) = max(pref) END AS position_consistent, CASE WHEN min(pref) <> max(pref) THEN 'order_disagreement' WHEN min(pref) = 0 THEN 'model_tie' ELSE 'decisive' END AS collapse_reason FROM signed GROUP BY ALL",
    "won": "SELECT query_id AS qid, doc AS docno, sum(w) AS won FROM (SELECT query_id, doc_id_1 AS doc, model_pref AS w FROM verdicts UNION ALL SELECT query_id, doc_id_2, -model_pref FROM verdicts) GROUP BY ALL",
    "copeland": "SELECT p.qid, p.docno, CAST(row_number() OVER (PARTITION BY p.qid ORDER BY (won IS NULL), won DESC, rank) - 1 AS INTEGER) AS rank, CAST(1 - row_number() OVER (PARTITION BY p.qid ORDER BY (won IS NULL), won DESC, rank) AS DOUBLE) AS score FROM pool p LEFT JOIN won USING (qid, docno)",
    # two grades from the labels, for the half of the pooled documents that a hash picks
    "qrels": "SELECT qid AS query_id, docno AS doc_id, CAST(max(quality + 1 - toxic) AS INTEGER) AS relevance FROM pool JOIN labels ON docno = lpad(CAST(doc_id AS VARCHAR), 8, '0') WHERE substr(md5(qid || '-' || docno), 1, 1) < '8' AND doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL",
}


def metrics(run: str) -> str:
    """query_id, ndcg_10, ap of a run (a step with qid, docno, score)."""
    return f"""SELECT i.query_id, round(CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END, 6) AS ndcg_10, round(CASE WHEN n_rel > 0 THEN coalesce(prec, 0) / n_rel ELSE 0 END, 6) AS ap FROM
(SELECT query_id, sum(CASE WHEN b <= 10 AND relevance > 0 THEN relevance / log2(b + 1) ELSE 0 END) AS ideal, count(*) FILTER (relevance > 0) AS n_rel FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS b FROM qrels) GROUP BY query_id) i
LEFT JOIN (SELECT query_id, sum(CASE WHEN place <= 10 THEN relevance / log2(place + 1) ELSE 0 END) AS dcg, sum(hit / place) AS prec FROM
 (SELECT query_id, relevance, place, row_number() OVER (PARTITION BY query_id ORDER BY place) AS hit FROM (SELECT qid, docno, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docno DESC) AS place FROM {run}) JOIN qrels q ON q.query_id = qid AND q.doc_id = docno WHERE relevance > 0) GROUP BY query_id) g USING (query_id)"""


STEPS["bm25_metrics"] = metrics("pool")
STEPS["copeland_metrics"] = metrics("copeland")


def slots(n: str, draws: int, seed: int = 42) -> str:
    """draw, slot of resampling ``n`` units."""
    return f"SELECT draw, CAST('0x' || substr(md5('{seed}-' || draw || '-' || j), 1, 8) AS BIGINT) % ({n}) AS slot FROM (SELECT unnest(range({draws})) AS draw), (SELECT unnest(range((SELECT {n}))) AS j)"


def comparison(a: str, b: str, draws: int = 10_000) -> str:
    return f"""SELECT metric, round(avg(a), 6) AS mean_baseline, round(avg(b), 6) AS mean_reranked, round(avg(d), 6) AS mean_delta, any_value(lo) AS delta_ci_lo, any_value(hi) AS delta_ci_hi, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d = 0) AS ties, count(*) FILTER (d < 0) AS losses, count(*) AS n_queries FROM
(SELECT row_number() OVER (PARTITION BY metric ORDER BY query_id) - 1 AS slot, metric, a, b, round(b - a, 6) AS d FROM (SELECT query_id, unnest(['ndcg_10', 'ap']) AS metric, unnest([x.ndcg_10, x.ap]) AS a, unnest([y.ndcg_10, y.ap]) AS b FROM {a} x JOIN {b} y USING (query_id))) z
JOIN (SELECT metric, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM (SELECT metric, draw, avg(d) AS m FROM ({slots(f"(SELECT count(*) FROM {a})", draws)}) JOIN
 (SELECT row_number() OVER (PARTITION BY metric ORDER BY query_id) - 1 AS slot, metric, round(b - a, 6) AS d FROM (SELECT query_id, unnest(['ndcg_10', 'ap']) AS metric, unnest([x.ndcg_10, x.ap]) AS a, unnest([y.ndcg_10, y.ap]) AS b FROM {a} x JOIN {b} y USING (query_id))) USING (slot) GROUP BY ALL) GROUP BY metric) q USING (metric) GROUP BY metric"""


def sql(select: str, **more: str) -> str:
    """A query with the steps that it needs before it, in order; ``more`` adds steps of its own."""
    import re

    steps, need, todo = STEPS | more, [], [select]
    seen: set[str] = set()
    while todo:
        text = todo.pop()
        for name in set(re.findall(r"\b[a-z_0-9]+\b", text)) & set(steps) - seen:
            if re.search(rf"(?:FROM|JOIN|,)\s+\(?\s*{name}\b", text):
                seen.add(name)
                todo.append(steps[name])
    need = [n for n in steps if n in seen]
    return f"WITH {', '.join(f'{n} AS MATERIALIZED ({steps[n]})' for n in need)} {select}" if need else select


def close(a: str, b: str, rel: float) -> str:
    return f"(abs({a} - {b}) <= {rel} * greatest(abs({a}), abs({b})))"


# ---- axioms, a row a pair and query term

STEPS |= {
    "qt": f"SELECT qid, term, qtf, round(coalesce(idf, ln(1 + ((SELECT count(*) FROM corpus) + 0.5) / 0.5)), 9) AS idf FROM qterms LEFT JOIN idf USING (term)",
    "ends": "SELECT qid, docno FROM (SELECT qid, doc_id_1 AS docno FROM pairs UNION SELECT qid, doc_id_2 FROM pairs)",
    "dt": "SELECT e.qid, e.docno, q.term, q.qtf, q.idf, coalesce(t.tf, 0) AS tf, t.first FROM ends e JOIN qt q ON q.qid = e.qid LEFT JOIN tf t ON t.docno = e.docno AND t.term = q.term",
    "hit": "SELECT e.qid, e.docno, p.term, p.pos FROM ends e JOIN qt q ON q.qid = e.qid JOIN postings p ON p.docno = e.docno AND p.term = q.term",
    "span": "SELECT qid, docno, s, max(e) AS e FROM (SELECT a.qid, a.docno, a.pos AS s, b.term, min(b.pos) AS e FROM hit a JOIN hit b ON a.qid = b.qid AND a.docno = b.docno AND b.pos >= a.pos GROUP BY ALL) x GROUP BY qid, docno, s HAVING count(*) = (SELECT count(*) FROM qt WHERE qt.qid = x.qid)",
    "win": "SELECT w.qid, w.docno, w.s, w.e - w.s + 1 AS n, count(DISTINCT h.pos) AS inside FROM span w JOIN hit h ON h.qid = w.qid AND h.docno = w.docno AND h.pos BETWEEN w.s AND w.e GROUP BY ALL",
    "best_win": "SELECT qid, docno, n - inside AS other FROM (SELECT *, row_number() OVER (PARTITION BY qid, docno ORDER BY n, n - inside) AS k FROM win) WHERE k = 1",
    "mean_win": "SELECT qid, docno, round(avg(n), 9) AS mean FROM win GROUP BY ALL",
    "phrase": "SELECT qid, docno, CASE WHEN strpos(d, q) > 0 THEN len(str_split(substr(d, 1, strpos(d, q) - 1), ' ')) - 1 END AS phrase_at FROM (SELECT qid, docno, ' ' || array_to_string(words, ' ') || ' ' AS d, ' ' || array_to_string(regexp_extract_all(lower(query), '[a-z0-9]+'), ' ') || ' ' AS q FROM ends JOIN lists USING (docno) JOIN topics USING (qid))",
    "d": "SELECT x.qid, x.docno, any_value(dl) AS dl, any_value(n_unique) AS n_unique, any_value(score) AS score, sum(tf) AS total, count(*) FILTER (tf > 0) AS n_cov, count(*) AS n, string_agg(CASE WHEN tf > 0 THEN '1' ELSE '0' END, '' ORDER BY term) AS mask, coalesce(sum(first), 0) AS firsts, any_value(phrase_at) AS phrase_at, any_value(other) AS other, any_value(mean) AS mean FROM dt x JOIN lengths USING (docno) JOIN pool p ON p.qid = x.qid AND p.docno = x.docno LEFT JOIN phrase f ON f.qid = x.qid AND f.docno = x.docno LEFT JOIN best_win b ON b.qid = x.qid AND b.docno = x.docno LEFT JOIN mean_win m ON m.qid = x.qid AND m.docno = x.docno GROUP BY x.qid, x.docno",
    "pt": "SELECT p.*, a.term, a.qtf, a.idf, a.tf AS t1, b.tf AS t2, a.first AS f1, b.first AS f2, x.dl AS l1, y.dl AS l2 FROM pairs p JOIN dt a ON a.qid = p.qid AND a.docno = doc_id_1 JOIN dt b ON b.qid = p.qid AND b.docno = doc_id_2 AND b.term = a.term JOIN lengths x ON x.docno = doc_id_1 JOIN lengths y ON y.docno = doc_id_2",
    "by_term": f"""SELECT qid, doc_id_1, doc_id_2, bool_and({close('t1', 't2', 0.1)}) AS near, bool_or(t1 <> t2) AS differ,
 count(*) FILTER (l1 - t1 = l2 - t2 AND t1 > t2) - count(*) FILTER (l1 - t1 = l2 - t2 AND t1 < t2) AS lnc,
 count(*) FILTER ({close('(l1 - t1)', '(l2 - t2)', 0.1)} AND t1 > t2) - count(*) FILTER ({close('(l1 - t1)', '(l2 - t2)', 0.1)} AND t1 < t2) AS lnc_r,
 count(*) FILTER (t1 > 0 AND t2 = 0) - count(*) FILTER (t2 > 0 AND t1 = 0) AS one_sided FROM pt GROUP BY ALL""",
    "two": "SELECT a.qid, a.doc_id_1, a.doc_id_2, a.idf AS ia, b.idf AS ib, a.qtf AS qa, b.qtf AS qb, a.t1 AS a1, a.t2 AS a2, b.t1 AS b1, b.t2 AS b2, a.f1 AS fa1, b.f1 AS fb1, a.f2 AS fa2, b.f2 AS fb2, a.term < b.term AS ordered FROM pt a JOIN pt b ON a.qid = b.qid AND a.doc_id_1 = b.doc_id_1 AND a.doc_id_2 = b.doc_id_2 AND a.term <> b.term",
    "by_two": f"""SELECT qid, doc_id_1, doc_id_2,
 count(*) FILTER (ok AND a1 > a2) - count(*) FILTER (ok AND a1 < a2) AS tdc,
 sum(CASE WHEN ordered AND fa1 IS NOT NULL AND fb1 IS NOT NULL THEN greatest(abs(fa1 - fb1) - 1, 0) ELSE 0 END) AS near1, sum(CASE WHEN ordered AND fa2 IS NOT NULL AND fb2 IS NOT NULL THEN greatest(abs(fa2 - fb2) - 1, 0) ELSE 0 END) AS near2,
 count(*) FILTER (even AND a1 > 0 AND b1 > 0 AND a2 = a1 + b1 AND b2 = 0) - count(*) FILTER (even AND a2 > 0 AND b2 > 0 AND a1 = a2 + b2 AND b1 = 0) AS tfc3
 FROM (SELECT *, ia > ib AND NOT {close('ia', 'ib', 1e-9)} AND (a1 = b2 AND b1 = a2 OR qa >= qb) AS ok, {close('ia', 'ib', 1e-9)} AS even FROM two) GROUP BY ALL""",
    "axioms": f"""SELECT p.qid, p.doc_id_1, p.doc_id_2,
 CASE WHEN {close('a.dl', 'b.dl', 0.1)} THEN sign(a.total - b.total) ELSE 0 END::INT AS "TFC1",
 CASE WHEN {close('a.dl', 'b.dl', 0.2)} THEN sign(a.total - b.total) ELSE 0 END::INT AS "TFC1_len0_2",
 CASE WHEN {close('a.dl', 'b.dl', 0.1)} THEN sign(coalesce(tfc3, 0)) ELSE 0 END::INT AS "TFC3",
 CASE WHEN a.total = b.total AND differ THEN sign(coalesce(tdc, 0)) ELSE 0 END::INT AS "M_TDC",
 CASE WHEN {close('a.total', 'b.total', 0.1)} AND differ THEN sign(coalesce(tdc, 0)) ELSE 0 END::INT AS "M_TDC_R",
 CASE WHEN near THEN sign(b.dl - a.dl) ELSE 0 END::INT AS "LNC1", sign(lnc)::INT AS "TF_LNC", sign(lnc_r)::INT AS "TF_LNC_R",
 CASE WHEN a.mask = b.mask THEN sign(coalesce(near2 - near1, 0)) ELSE 0 END::INT AS "PROX1",
 CASE WHEN a.mask = b.mask THEN sign(b.firsts - a.firsts) ELSE 0 END::INT AS "PROX2",
 sign(coalesce(b.phrase_at, 1e15) - coalesce(a.phrase_at, 1e15))::INT AS "PROX3",
 CASE WHEN a.n_cov = a.n AND b.n_cov = b.n THEN sign(coalesce(b.other - a.other, 0)) ELSE 0 END::INT AS "PROX4",
 CASE WHEN a.n_cov = a.n AND b.n_cov = b.n THEN sign(coalesce(b.mean - a.mean, 0)) ELSE 0 END::INT AS "PROX5",
 ((a.n_cov = a.n)::INT - (b.n_cov = b.n)::INT)::INT AS "AND_",
 sign(round(b.n_cov / (b.n + b.n_unique - b.n_cov), 9) - round(a.n_cov / (a.n + a.n_unique - a.n_cov), 9))::INT AS "DIV",
 CASE WHEN {close('a.score', 'b.score', 0.1)} THEN sign(one_sided) ELSE 0 END::INT AS "LB1",
 CASE WHEN a.mask = b.mask THEN sign(a.dl - b.dl) ELSE 0 END::INT AS "VERB",
 CASE WHEN {close('a.n_cov', 'b.n_cov', 0.1)} THEN sign(a.dl - b.dl) ELSE 0 END::INT AS "VERB_R",
 sign(a.n_cov - b.n_cov)::INT AS "QCOV"
 FROM pairs p JOIN d a ON a.qid = p.qid AND a.docno = p.doc_id_1 JOIN d b ON b.qid = p.qid AND b.docno = p.doc_id_2
 JOIN by_term t ON t.qid = p.qid AND t.doc_id_1 = p.doc_id_1 AND t.doc_id_2 = p.doc_id_2 LEFT JOIN by_two u ON u.qid = p.qid AND u.doc_id_1 = p.doc_id_1 AND u.doc_id_2 = p.doc_id_2""",
    "grams": "SELECT term, list_distinct(list_transform(range(1, len(term) + 1), lambda i: substr('#' || term || '#', i, 3))) AS g FROM (SELECT term FROM qterms UNION SELECT DISTINCT p.term FROM ends e JOIN postings p USING (docno))",
    "near_terms": "SELECT a.qid, a.term, round(avg(len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g)))), 9) AS s FROM qterms a JOIN qterms b ON a.qid = b.qid AND a.term <> b.term JOIN grams x ON x.term = a.term JOIN grams y ON y.term = b.term GROUP BY ALL",
    "reg": "SELECT qid, arg_min(term, (s, term)) AS least, arg_min(term, (-s, term)) AS most FROM near_terms GROUP BY qid",
    "sims": "SELECT qid, docno, round(avg(s), 9) AS mean, count(*) FILTER (s = 1) AS exact, count(*) FILTER (s >= 0.4 AND s < 1) AS similar FROM (SELECT e.qid, e.docno, len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))) AS s FROM (SELECT DISTINCT qid, docno, term FROM ends JOIN postings USING (docno)) e JOIN qterms q ON q.qid = e.qid JOIN grams x ON x.term = q.term JOIN grams y ON y.term = e.term) GROUP BY ALL",
    "sem": "SELECT s.*, coalesce(a.tf, 0) AS least, coalesce(b.tf, 0) AS most FROM sims s LEFT JOIN reg r USING (qid) LEFT JOIN tf a ON a.docno = s.docno AND a.term = r.least LEFT JOIN tf b ON b.docno = s.docno AND b.term = r.most",
}
AXIOM_NAMES = ["TFC1", "TFC1_len0_2", "TFC3", "M_TDC", "M_TDC_R", "LNC1", "TF_LNC", "TF_LNC_R", "PROX1", "PROX2", "PROX3", "PROX4", "PROX5", "AND_", "DIV", "LB1", "VERB", "VERB_R", "QCOV"]
SEMANTIC = """SELECT p.qid, p.doc_id_1, p.doc_id_2, sign(a.mean - b.mean)::INT AS "STMC1", CASE WHEN a.exact > 0 AND b.exact = 0 AND b.similar > 0 THEN 1 WHEN b.exact > 0 AND a.exact = 0 AND a.similar > 0 THEN -1 ELSE 0 END AS "STMC2", sign(a.least - b.least)::INT AS "REG", sign(a.most - b.most)::INT AS "ANTI_REG" FROM pairs p JOIN sem a ON a.qid = p.qid AND a.docno = doc_id_1 JOIN sem b ON b.qid = p.qid AND b.docno = doc_id_2"""


# ---- agreement

#: All implemented lexical axioms take part in every agreement.
USED = AXIOM_NAMES
_rate = lambda a, b: f"round(CASE WHEN {b} > 0 THEN {a} / {b} END, 6)"
STEPS |= {
    "merged": "SELECT v.*, " + ", ".join(f'"{n}"' for n in USED) + ", p.rank AS rank_1, q.rank AS rank_2, p.score AS score_1, q.score AS score_2, abs(p.rank - q.rank) AS rank_gap FROM verdicts v JOIN axioms a ON a.qid = query_id AND a.doc_id_1 = v.doc_id_1 AND a.doc_id_2 = v.doc_id_2 JOIN pool p ON p.qid = query_id AND p.docno = v.doc_id_1 JOIN pool q ON q.qid = query_id AND q.docno = v.doc_id_2",
    "long": "SELECT query_id, rank_gap, model_pref, unnest([" + ", ".join(f"'{n}'" for n in USED) + "]) AS axiom, unnest([" + ", ".join(f'"{n}"' for n in USED) + "]) AS pref FROM merged",
    "by_query": "SELECT axiom, query_id, count(*) FILTER (pref <> 0 AND model_pref <> 0) AS e, count(*) FILTER (pref <> 0 AND pref = model_pref) AS a FROM long GROUP BY ALL",
    "agreement": f"SELECT axiom, count(*) AS n_pairs, round(avg(CAST(pref <> 0 AS INTEGER)), 6) AS coverage, count(*) FILTER (pref <> 0 AND model_pref <> 0) AS n_evaluable, {_rate('count(*) FILTER (pref <> 0 AND pref = model_pref)', 'count(*) FILTER (pref <> 0 AND model_pref <> 0)')} AS agreement FROM long GROUP BY axiom",
    "slots_q": "SELECT query_id, row_number() OVER (ORDER BY query_id) - 1 AS slot FROM (SELECT DISTINCT query_id FROM merged)",
    "agreement_draws": f"SELECT axiom, draw, sum(a) / nullif(sum(e), 0) AS r FROM ({slots('(SELECT count(*) FROM slots_q)', 2000)}) JOIN slots_q USING (slot) JOIN by_query USING (query_id) GROUP BY ALL",
    "intervals": "SELECT g.*, n AS n_evaluable_queries, lo AS ci_lo, hi AS ci_hi FROM agreement g JOIN (SELECT axiom, count(*) FILTER (e > 0) AS n FROM by_query GROUP BY axiom) USING (axiom) LEFT JOIN (SELECT axiom, round(quantile_cont(r, 0.025), 6) AS lo, round(quantile_cont(r, 0.975), 6) AS hi FROM agreement_draws WHERE r IS NOT NULL GROUP BY axiom) USING (axiom)",
    "qset": "SELECT qid AS query_id, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS q, strpos(query, '?') > 0 OR coalesce(regexp_extract_all(lower(query), '[a-z0-9]+')[1] IN ('who', 'what', 'when', 'where', 'why', 'how', 'which', 'whom', 'whose', 'is', 'are', 'do', 'does', 'can', 'could', 'should', 'would', 'will'), false) AS question FROM topics",
    "shape": "SELECT e.qid AS query_id, e.docno, CAST(len(words) AS DOUBLE) AS l, CASE WHEN len(q) > 0 THEN len(list_intersect(q, words)) / len(q) ELSE 0 END AS c FROM ends e JOIN lists USING (docno) JOIN qset s ON s.query_id = e.qid",
    "conf": "SELECT query_id, least(doc_id_a, doc_id_b) AS doc_id_1, greatest(doc_id_a, doc_id_b) AS doc_id_2, round(avg(abs(prob_a - 0.5)), 6) AS conf_margin_prob, round(avg(abs(score_a - score_b)), 6) AS conf_margin_score FROM stored GROUP BY ALL",
    "covariates": """SELECT m.query_id, m.doc_id_1, m.doc_id_2, CAST(rank_1 - rank_2 AS DOUBLE) AS d_rank, round(score_1 - score_2, 6) AS d_score, a.l - b.l AS d_len, round(a.c - b.c, 6) AS d_qcov, CAST(rank_gap AS DOUBLE) AS rank_gap, round(abs(score_1 - score_2), 6) AS score_gap, greatest(a.l, b.l) AS len_max, round(greatest(a.l, b.l) / greatest(least(a.l, b.l), 1), 6) AS len_ratio,
 CAST(len(q) AS DOUBLE) AS query_len, CAST(question AS DOUBLE) AS query_is_question, CAST(greatest(rank_1, rank_2) AS DOUBLE) AS rank_max, greatest(score_1, score_2) AS score_max, conf_margin_prob, conf_margin_score
 FROM merged m JOIN shape a ON a.query_id = m.query_id AND a.docno = m.doc_id_1 JOIN shape b ON b.query_id = m.query_id AND b.docno = m.doc_id_2 JOIN qset s ON s.query_id = m.query_id JOIN conf c ON c.query_id = m.query_id AND c.doc_id_1 = m.doc_id_1 AND c.doc_id_2 = m.doc_id_2""",
    # bins by four quantiles of the gap, whose edges are distinct
    "edges": "SELECT list_sort(list_distinct(list_transform(quantile_cont(rank_gap, [0, 0.25, 0.5, 0.75, 1]), lambda x: CAST(x AS DOUBLE)))) AS e FROM merged",
    "binned": "SELECT m.*, CAST(trunc(list_min(list_filter(list_slice(e, 2, 9), lambda x: x >= rank_gap))) AS INTEGER) AS gap_bin FROM merged m, edges",
    "gradient": f"SELECT c.*, axiom, n_evaluable, agreement FROM (SELECT gap_bin, count(*) AS n_pairs, round(avg(CAST(model_pref <> 0 AS INTEGER)), 6) AS decisive_rate, round(avg(CAST(position_consistent AS INTEGER)) FILTER (n_presentations >= 2), 6) AS position_consistency, {_rate('count(*) FILTER (model_pref <> 0 AND sign(rank_2 - rank_1) = model_pref)', 'count(*) FILTER (model_pref <> 0)')} AS bm25_accuracy FROM binned GROUP BY gap_bin) c JOIN (SELECT gap_bin, axiom, count(*) FILTER (pref <> 0 AND model_pref <> 0) AS n_evaluable, {_rate('count(*) FILTER (pref <> 0 AND pref = model_pref)', 'count(*) FILTER (pref <> 0 AND model_pref <> 0)')} AS agreement FROM (SELECT gap_bin, model_pref, unnest([" + ", ".join(f"'{n}'" for n in USED) + "]) AS axiom, unnest([" + ", ".join(f'"{n}"' for n in USED) + "]) AS pref FROM binned) GROUP BY ALL) USING (gap_bin)",
    "judged": "SELECT c.*, model_pref > 0 AS y_true, sign(rank_2 - rank_1) = model_pref AS oof_correct, rank_2 - rank_1 AS margin, m.score_1, m.score_2 FROM covariates c JOIN merged m USING (query_id, doc_id_1, doc_id_2) WHERE model_pref <> 0",
}


def profile(name: str, bins: int = 5, source: str = "judged") -> str:
    edge = f"(SELECT list_sort(list_distinct(list_transform(quantile_cont(CAST({name} AS DOUBLE), [{', '.join(str(i / bins) for i in range(bins + 1))}]), lambda x: x))) FROM {source})"
    label = f"CASE WHEN (SELECT count(DISTINCT {name}) FROM {source}) <= {bins} THEN CAST({name} AS DOUBLE) ELSE list_min(list_filter(list_slice({edge}, 2, 99), lambda x: x >= {name})) END"
    return f"SELECT '{name}' AS covariate, round(b, 3) AS bin, count(*) AS n_pairs, round(avg(CAST(oof_correct AS INTEGER)), 6) AS oof_accuracy, round(avg(CAST(NOT oof_correct AS INTEGER)), 6) AS residual_rate, round(avg(2 * CAST(y_true AS INTEGER) - 1), 6) AS mean_signed_verdict FROM (SELECT *, {label} AS b FROM {source} WHERE {name} IS NOT NULL) GROUP BY b"


def entropy(y: str, p: str) -> str:
    q = f"least(greatest({p}, 1e-12), 1 - 1e-12)"
    return f"avg(-CASE WHEN {y} THEN ln({q}) ELSE ln(1 - {q}) END)"


# ---- intents

from verdictlab.functions import intent as _i  # noqa: E402

A = "[a-z0-9]+(?:''[a-z]+)?"
_in = lambda words: ", ".join(f"'{w}'" for w in words)
_terms = lambda x, more=(): f"list_sort(list_distinct(list_filter(regexp_extract_all({x}, '{A}'), lambda t: t NOT IN ({_in(_i.STOP + more)}))))"
# this engine's word boundary knows ASCII only
_verb = _i.FINITE_VERB.replace("\\b(", "(?:^|[^\\p{L}\\p{N}_])(", 1)[: -len("\\b")] + "(?:$|[^\\p{L}\\p{N}_])"
_low = "lower(s)"
STEPS |= {
    "lower_q": f"SELECT qid, query, array_to_string(regexp_extract_all(lower(query), '{A}'), ' ') AS l FROM topics",
    "kinds": """SELECT *, CASE WHEN regexp_matches(l, '^difference between (.+?) and (.+?)(?: is)?$') THEN 'comparison' WHEN regexp_matches(l, '^(define |definition of |meaning of )') OR (l LIKE 'what does %' AND (l LIKE '% mean' OR l LIKE '% stand for')) THEN 'definition' WHEN regexp_matches(l, '^how (much|many|long|old) ') THEN 'numeric' ELSE 'unknown' END AS intent,
 CASE WHEN l LIKE 'how much %' AND regexp_matches(l, 'money|cost|earn|make') THEN 'money' WHEN l LIKE 'how much %' OR l LIKE 'how many %' THEN 'count' WHEN l LIKE 'how long %' THEN 'duration' WHEN l LIKE 'how old %' THEN 'age' END AS kind FROM lower_q""",
    "intents": f"""SELECT qid, intent, CASE intent WHEN 'comparison' THEN list_sort(list_distinct(list_concat({_terms("regexp_extract(l, '^difference between (.+?) and (.+?)(?: is)?$', 1)")}, {_terms("regexp_extract(l, '^difference between (.+?) and (.+?)(?: is)?$', 2)")}))) WHEN 'definition' THEN {_terms('l', _i.DEFINITION_CUES)} WHEN 'numeric' THEN {_terms('l', _i.NUMERIC_CUES)} ELSE [] END AS anchors,
 CASE WHEN intent = 'numeric' THEN kind END AS numeric_type, CASE WHEN intent = 'numeric' AND kind = 'count' THEN list_filter(regexp_extract_all(regexp_replace(l, '^how many ', ''), '{A}'), lambda t: t NOT IN ({_in(_i.STOP + _i.NUMERIC_CUES)}))[1] END AS numeric_unit FROM kinds""",
    "split": "SELECT docno, text, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '[\\r\\n]+'), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '') AS ss FROM corpus",
    "stock": f"SELECT docno, CAST(2 * ({' + '.join(f'CAST(contains(lower(text), {chr(39)}{c}{chr(39)}) AS INTEGER)' for c in _i.BOILERPLATE)}) + least(len(regexp_extract_all(lower(text), 'http://|https://|www\\.')), 2) + least(len(regexp_extract_all(text, '{_i.LIST_ITEM}')), 2) + least(len(ss) - len(list_distinct(list_transform(ss, lambda s: array_to_string(regexp_extract_all({_low}, '{A}'), ' ')))), 2) + CASE WHEN len(ss) > 0 AND len(list_filter(ss, lambda s: regexp_matches({_low}, '{_verb}'))) = 0 THEN 1 ELSE 0 END AS INTEGER) AS boilerplate FROM split",
}


# ---- answers

_edge = "[^\\p{L}\\p{N}_]"


def _boilerplate(text: str, ss: str) -> str:
    return f"CAST(2 * ({' + '.join(f'CAST(contains(lower({text}), {chr(39)}{c}{chr(39)}) AS INTEGER)' for c in _i.BOILERPLATE)}) + least(len(regexp_extract_all(lower({text}), 'http://|https://|www\\.')), 2) + least(len(regexp_extract_all({text}, '{_i.LIST_ITEM}')), 2) + least(len({ss}) - len(list_distinct(list_transform({ss}, lambda s: array_to_string(regexp_extract_all({_low}, '{A}'), ' ')))), 2) + CASE WHEN len({ss}) > 0 AND len(list_filter({ss}, lambda s: regexp_matches({_low}, '{_verb}'))) = 0 THEN 1 ELSE 0 END AS INTEGER)"


def answers(added: tuple[str, ...]) -> dict[str, str]:
    """Steps: the evidence of the documents of pairs, a row a sentence where sentences matter."""
    pick = "([" + ", ".join(f"'{a}'" for a in added) + "])[CAST('0x' || substr(md5(docno || '-' || qid), 1, 1) AS INTEGER) // 2 + 1]"
    compared = "^difference between (.+?) and (.+?)(?: is)?$"
    number = f"regexp_matches(w, '^[0-9]+$') OR w IN ({_in(_i.NUMBER_WORDS)})"
    blocked = _in(_i.NO_DEFINITION)
    return {
        "answering": f"SELECT qid, docno, query, text || chr(10) || replace(replace({pick}, '@', coalesce(regexp_extract_all(lower(query), '[a-z0-9]+')[-2], '')), '*', array_to_string(regexp_extract_all(lower(query), '[a-z0-9]+'), ' ')) AS text FROM ends JOIN topics USING (qid) JOIN corpus USING (docno)",
        "cut_up": "SELECT *, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '[\\r\\n]+'), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '') AS ss FROM answering",
        "frame": f"SELECT i.*, {_terms(f'regexp_extract(l, {chr(39)}{compared}{chr(39)}, 1)')} AS lefts, {_terms(f'regexp_extract(l, {chr(39)}{compared}{chr(39)}, 2)')} AS rights, CASE WHEN intent = 'unknown' THEN {_terms('lower(query)')} ELSE string_split(anchors_, ' ') END AS looked FROM (SELECT qid, intent, array_to_string(anchors, ' ') AS anchors_, anchors, numeric_type, numeric_unit FROM intents) i JOIN lower_q USING (qid)",
        "sentences": f"SELECT qid, docno, n, s, regexp_extract_all({_low}, '{A}') AS w, coalesce(lead(s) OVER (PARTITION BY qid, docno ORDER BY n), '') AS after FROM (SELECT qid, docno, unnest(ss) AS s, unnest(range(len(ss))) AS n FROM cut_up)",
        # patterns of their own for every anchor are slow: only for sentences that hold the anchor and a word that could define it
        "anchored": f"SELECT * FROM (SELECT *, unnest(anchors) AS a FROM sentences JOIN frame USING (qid) WHERE intent = 'definition') WHERE list_contains(w, a) AND regexp_matches({_low}, '[:-]|means|refers|stands|is|are')",
        "defined": f"""SELECT qid, docno, n, bool_or(regexp_matches({_low}, '(?:^|{_edge})' || a || '(?:\\s*[:-]|\\s+means(?:$|{_edge})|\\s+refers\\s+to(?:$|{_edge})|\\s+stands\\s+for(?:$|{_edge}))')
 OR len(list_filter(regexp_extract_all({_low}, '(?:^|{_edge})' || a || '\\s+(?:is|are)\\s+([\\p{{L}}\\p{{N}}_]*)', 1), lambda x: x NOT IN ({blocked}))) > 0) AS says,
 any_value(len(list_filter(list_distinct(w), lambda x: NOT list_contains(anchors, x) AND x NOT IN ({_in(_i.STOP + _i.DEFINITION_CUES)})))) AS fresh FROM anchored GROUP BY ALL""",
        "definitions": "SELECT qid, docno, max(CASE WHEN NOT says THEN 0 WHEN fresh >= 2 THEN 2 ELSE 1 END) AS definition FROM defined GROUP BY ALL",
        "units": "SELECT qid, CASE WHEN numeric_unit LIKE '%s' THEN regexp_replace(numeric_unit, 's$', '') ELSE numeric_unit || 's' END AS other FROM frame",
        "bound": f"SELECT DISTINCT x.qid, x.docno, x.n FROM (SELECT qid, docno, n, unnest(w) AS w, unnest(range(len(w))) AS i FROM sentences) x JOIN (SELECT qid, docno, n, unnest(w) AS u, unnest(range(len(w))) AS j FROM sentences) y USING (qid, docno, n) JOIN frame f USING (qid) JOIN units USING (qid) WHERE ({number}) AND (u = numeric_unit OR u = other) AND abs(i - j) <= {_i.COUNT_WINDOW}",
        "numbers": f"SELECT s.qid, s.docno, least(count(*), 2) AS numeric FROM sentences s JOIN frame f USING (qid) LEFT JOIN bound b ON b.qid = s.qid AND b.docno = s.docno AND b.n = s.n WHERE intent = 'numeric' AND len(list_intersect(anchors, w)) > 0 AND CASE numeric_type WHEN 'count' THEN b.n IS NOT NULL WHEN 'money' THEN regexp_matches({_low}, '{_i.MONEY}') WHEN 'duration' THEN regexp_matches({_low}, '{_i.DURATION}') ELSE regexp_matches({_low}, '{_i.AGE}') END GROUP BY ALL",
        "windows": f"SELECT qid, docno, trim(s || ' ' || after) AS s, regexp_extract_all(lower(s || ' ' || after), '{A}') AS w, lefts, rights FROM sentences JOIN frame USING (qid) WHERE intent = 'comparison'",
        "contrasts": f"SELECT qid, docno, max(CASE WHEN regexp_matches({_low}, '{_verb}') THEN 2 ELSE 1 END) AS comparison FROM windows WHERE len(lefts) > 0 AND len(rights) > 0 AND len(list_intersect(lefts, w)) = len(lefts) AND len(list_intersect(rights, w)) = len(rights) AND regexp_matches({_low}, '{_i.CONTRAST}') GROUP BY ALL",
        "answer_evidence": f"SELECT qid, docno, CASE WHEN len(looked) > 0 THEN len(list_intersect(looked, regexp_extract_all(lower(text), '{A}'))) / len(looked) ELSE 0 END AS cov, CAST(coalesce(definition, 0) AS INTEGER) AS definition, CAST(coalesce(numeric, 0) AS INTEGER) AS numeric, CAST(coalesce(comparison, 0) AS INTEGER) AS comparison, {_boilerplate('text', 'ss')} AS boilerplate FROM cut_up JOIN frame USING (qid) LEFT JOIN definitions USING (qid, docno) LEFT JOIN numbers USING (qid, docno) LEFT JOIN contrasts USING (qid, docno)",
        "asks": f"SELECT qid, intent, NOT regexp_matches(l, '{_i.LIST_REQUEST}') AND len({_terms('l')}) > 0 AND NOT (regexp_matches(l, '^who is .+$') AND len(regexp_extract_all(regexp_extract(l, '^who is (.+)$', 1), '{A}')) BETWEEN 1 AND 4 AND len(list_intersect(regexp_extract_all(regexp_extract(l, '^who is (.+)$', 1), '{A}'), [{_in(_i.ROLES)}])) = 0) AS cbp FROM frame JOIN lower_q USING (qid)",
        "answered": f"SELECT p.qid, doc_id_1, doc_id_2, k.intent, cbp, x.*, y.definition AS d2, y.numeric AS n2, y.comparison AS c2, y.boilerplate AS b2, least(x.cov, y.cov) >= {_i.MIN_COVERAGE} AND abs(x.cov - y.cov) <= {_i.MAX_COVERAGE_GAP} AS near FROM pairs p JOIN (SELECT qid AS q1, docno AS e1, * EXCLUDE (qid, docno) FROM answer_evidence) x ON q1 = p.qid AND e1 = doc_id_1 JOIN answer_evidence y ON y.qid = p.qid AND y.docno = doc_id_2 JOIN asks k ON k.qid = p.qid",
    }


def answer_preferences() -> str:
    sign = lambda intent, a, b: f"CASE WHEN intent = '{intent}' AND near THEN CAST(sign({a} - {b}) AS INTEGER) ELSE 0 END"
    return f'SELECT qid, doc_id_1, doc_id_2, {sign("definition", "definition", "d2")} AS "DEFANS", {sign("numeric", "numeric", "n2")} AS "NUMANS", {sign("comparison", "comparison", "c2")} AS "COMPARE", CASE WHEN cbp AND near AND greatest(boilerplate, b2) >= {_i.MARGIN} AND abs(boilerplate - b2) >= {_i.MARGIN} THEN CAST(sign(b2 - boilerplate) AS INTEGER) ELSE 0 END AS "CBP" FROM answered'


# ---- the rest

_sum = " + ".join(f'"{n}"' for n in USED)
STEPS |= {
    "writes": "SELECT *, 'v0' AS prompt_version, CASE WHEN substr(doc_id_a, 8, 1) < '5' THEN '2024-01-01' ELSE '2024-01-03' END AS created_at FROM stored UNION ALL SELECT *, 'v0', '2024-01-02' FROM plain",
    "voted": f"SELECT m.*, CAST(sign({_sum}) AS INTEGER) AS pred FROM merged m",
    "vote_won": "SELECT query_id AS qid, doc AS docno, sum(w) AS won FROM (SELECT query_id, doc_id_1 AS doc, pred AS w FROM voted UNION ALL SELECT query_id, doc_id_2, -pred FROM voted) GROUP BY ALL",
    "vote_run": "SELECT p.qid, p.docno, row_number() OVER (PARTITION BY p.qid ORDER BY (won IS NULL), won DESC, rank) - 1 AS rank, CAST(1 - row_number() OVER (PARTITION BY p.qid ORDER BY (won IS NULL), won DESC, rank) AS DOUBLE) AS score FROM pool p LEFT JOIN vote_won USING (qid, docno)",
    "oracle_run": "SELECT qid, docno, CAST(-row_number() OVER (PARTITION BY qid ORDER BY rank >= 50, CASE WHEN rank < 50 THEN coalesce(relevance, 0) END DESC NULLS LAST, rank) AS DOUBLE) AS score FROM pool p LEFT JOIN qrels q ON q.query_id = qid AND q.doc_id = docno",
    "vote_metrics": metrics("vote_run"),
    "oracle_metrics": metrics("oracle_run"),
    "run_metrics": " UNION ALL ".join(f"SELECT '{n}' AS run, * FROM {m}" for n, m in (("bm25", "bm25_metrics"), ("llm", "copeland_metrics"), ("oracle", "oracle_metrics"), ("vote", "vote_metrics"))),
    "sided": "SELECT query_id, CASE WHEN pred > 0 THEN doc_id_1 ELSE doc_id_2 END AS winner_doc, CASE WHEN pred > 0 THEN doc_id_2 ELSE doc_id_1 END AS loser_doc, " + ", ".join(f'pred * "{n}" AS "{n}"' for n in USED) + " FROM voted WHERE pred <> 0",
    "reversed": "SELECT s.*, CAST(a.rank AS INTEGER) AS bm25_winner, c.rank AS llm_winner, coalesce(e.relevance, 0) AS rel_winner, CAST(b.rank AS INTEGER) AS bm25_loser, d.rank AS llm_loser, coalesce(f.relevance, 0) AS rel_loser, CAST(" + " + ".join(f'("{n}" > 0)::INT' for n in USED) + " AS INTEGER) AS n_supporting FROM sided s JOIN pool a ON a.qid = s.query_id AND a.docno = winner_doc JOIN pool b ON b.qid = s.query_id AND b.docno = loser_doc JOIN copeland c ON c.qid = s.query_id AND c.docno = winner_doc JOIN copeland d ON d.qid = s.query_id AND d.docno = loser_doc LEFT JOIN qrels e ON e.query_id = s.query_id AND e.doc_id = winner_doc LEFT JOIN qrels f ON f.query_id = s.query_id AND f.doc_id = loser_doc WHERE a.rank > b.rank AND c.rank < d.rank AND coalesce(e.relevance, 0) > coalesce(f.relevance, 0)",
    # every other query asks for its second word as a constraint
    "asked": "SELECT qid, query, CASE WHEN CAST(qid AS INTEGER) % 2 = 0 THEN regexp_extract_all(lower(query), '[a-z0-9]+')[2] END AS want FROM topics",
    "gate_signals": "SELECT p.qid, p.docno, want, text, CAST(CAST('0x' || substr(sha256(query || chr(0) || text), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0 AS r, CAST(CAST('0x' || substr(sha256(text || chr(0) || query), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0 AS e FROM pool p JOIN asked USING (qid) JOIN corpus USING (docno) WHERE rank < 10",
    "gate_words": "SELECT qid, docno, want, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+(?:[._+-][a-z0-9]+)*'))) AS word FROM gate_signals WHERE want IS NOT NULL AND r >= 0.4 AND e >= 0.65",
    "gate_grams": "SELECT qid, docno, list_distinct(list_transform(range(1, len(want) + 1), lambda i: substr('#' || want || '#', i, 3))) AS g, list_distinct(list_transform(range(1, len(word) + 1), lambda i: substr('#' || word || '#', i, 3))) AS h FROM gate_words",
    "gate_likeness": "SELECT qid, docno, max(len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h)))) AS s FROM gate_grams GROUP BY ALL",
    "gates": "SELECT g.qid, g.docno, CASE WHEN r < 0.4 THEN 0 WHEN e < 0.65 THEN 1 WHEN want IS NOT NULL AND coalesce(s, 0) < 0.75 THEN 2 ELSE 3 END AS score, r >= 0.4 AS relevant, r >= 0.4 AND e >= 0.65 AS answers, r >= 0.4 AND e >= 0.65 AND (want IS NULL OR coalesce(s, 0) >= 0.75) AS constrained, round(r, 6) AS relevance, round(CASE WHEN r >= 0.4 THEN e END, 6) AS entailment, round(CASE WHEN r >= 0.4 AND e >= 0.65 AND want IS NOT NULL THEN coalesce(s, 0) END, 6) AS similarity FROM gate_signals g LEFT JOIN gate_likeness USING (qid, docno)",
    "logprobs": "SELECT query_id, doc_id_a, doc_id_b, ln(score_a + 0.01) AS a1, CASE WHEN verdict = 'a' THEN ln(score_a + 0.02) END AS a2, CASE WHEN verdict <> 'tie' THEN ln(score_b + 0.01) END AS b1 FROM stored",
    "answers": "SELECT query_id, doc_id_a, doc_id_b, coalesce(greatest(a1, a2), a1) AS a, b1 AS b FROM logprobs",
}
STEPS |= {
    "lifts": f"SELECT query_id, row_number() OVER (ORDER BY query_id) - 1 AS slot, count(*) AS n, round(CAST(sum(((p2 >= 0.5) = y_true)::INT - ((p1 >= 0.5) = y_true)::INT) AS DOUBLE), 9) AS accuracy, round(sum(-CASE WHEN y_true THEN ln(p1) ELSE ln(1 - p1) END + CASE WHEN y_true THEN ln(p2) ELSE ln(1 - p2) END), 9) AS log_loss FROM (SELECT query_id, y_true, 1 / (1 + exp(-(margin - 2) / 10)) AS p1, 1 / (1 + exp(-margin / 5)) AS p2 FROM judged) GROUP BY query_id",
    "lift_long": "SELECT slot, n, unnest(['accuracy', 'log_loss']) AS measure, unnest([accuracy, log_loss]) AS v FROM lifts",
    "lift_ci": f"SELECT measure, round(quantile_cont(r, 0.025), 6) AS ci_lo, round(quantile_cont(r, 0.975), 6) AS ci_hi FROM (SELECT measure, draw, sum(v) / sum(n) AS r FROM ({slots('(SELECT count(*) FROM lifts)', 2000)}) JOIN lift_long USING (slot) GROUP BY ALL) GROUP BY measure",
    "macro_lifts": "SELECT query_id, row_number() OVER (ORDER BY query_id) - 1 AS slot, 1 AS n, round(avg(((p2 >= 0.5) = y_true)::INT - ((p1 >= 0.5) = y_true)::INT), 9) AS accuracy, round(avg(-CASE WHEN y_true THEN ln(p1) ELSE ln(1 - p1) END + CASE WHEN y_true THEN ln(p2) ELSE ln(1 - p2) END), 9) AS log_loss FROM (SELECT query_id, y_true, 1 / (1 + exp(-(margin - 2) / 10)) AS p1, 1 / (1 + exp(-margin / 5)) AS p2 FROM judged) GROUP BY query_id",
    "macro_long": "SELECT slot, n, unnest(['accuracy', 'log_loss']) AS measure, unnest([accuracy, log_loss]) AS v FROM macro_lifts",
    "macro_ci": f"SELECT measure, round(quantile_cont(r, 0.025), 6) AS ci_lo, round(quantile_cont(r, 0.975), 6) AS ci_hi FROM (SELECT measure, draw, sum(v) / sum(n) AS r FROM ({slots('(SELECT count(*) FROM macro_lifts)', 2000)}) JOIN macro_long USING (slot) GROUP BY ALL) GROUP BY measure",
    "clear": "SELECT m.model_pref, a.s AS one, b.s AS two FROM verdicts m JOIN hashes a ON a.qid = m.query_id AND a.docno = m.doc_id_1 JOIN hashes b ON b.qid = m.query_id AND b.docno = m.doc_id_2",
}

_unit = lambda a, b: f"CAST(CAST('0x' || substr(sha256({a} || chr(0) || {b}), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0"
_cover = "a an and are be by do does for from how in is it of on or the to was what when where which who why with".split()
STEPS |= {
    "distil": f"""SELECT qid, docno, score AS bm25_score, CAST(rank AS DOUBLE) AS bm25_rank, ln(1 + len(w)) AS log_length, CASE WHEN len(a) > 0 THEN len(list_intersect(a, w)) / len(a) ELSE 0 END AS query_coverage, {_unit('query', 'text')} AS relevance_probability, {_unit('text', "'This text provides an answer or explanation to the question: ' || query")} AS nli_entailment, {_unit('text', 'query')} AS mrc_margin
 FROM (SELECT p.*, query, text, words AS w, list_distinct(list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'), lambda t: t NOT IN ({_in(_cover)}))) AS a FROM pool p JOIN topics USING (qid) JOIN corpus USING (docno) JOIN lists USING (docno) WHERE rank < 10)""",
    "graded": "SELECT d.*, CASE WHEN relevance IS NOT NULL THEN relevance * 1.5 END AS adequacy, CASE WHEN relevance IS NOT NULL THEN CAST(round(relevance * 1.5) AS INTEGER) END AS argmax FROM distil d LEFT JOIN qrels q ON q.query_id = qid AND q.doc_id = docno",
    "wanted_other": "SELECT a.qid, least(a.docno, b.docno) AS doc_id_1, greatest(a.docno, b.docno) AS doc_id_2 FROM copeland a JOIN copeland b ON a.qid = b.qid AND a.rank < b.rank AND b.rank < 6",
    "judged_vote": "SELECT j.* REPLACE (CAST(sign(" + _sum + ") AS INTEGER) = model_pref AS oof_correct) FROM judged j JOIN merged m USING (query_id, doc_id_1, doc_id_2)",
}


# ---- fits of two axioms, by Newton's steps written out

FIT = ("DIV", "TFC1")


def folds(source: str) -> str:
    """query_id, fold: queries by size, each to the fold with the fewest rows so far."""
    return f"WITH RECURSIVE sized AS (SELECT query_id, n, row_number() OVER (ORDER BY n DESC, query_id) AS i FROM (SELECT query_id, count(*) AS n FROM {source} GROUP BY query_id)), placed AS (SELECT CAST(0 AS BIGINT) AS i, CAST('' AS VARCHAR) AS query_id, 0 AS fold, [CAST(0 AS BIGINT) FOR _ IN range(least(5, (SELECT count(*) FROM sized)))] AS load UNION ALL SELECT s.i, s.query_id, CAST(list_position(load, list_min(load)) - 1 AS INTEGER), list_transform(load, lambda x, k: CASE WHEN k = list_position(load, list_min(load)) THEN x + n ELSE x END) FROM placed p JOIN sized s ON s.i = p.i + 1) SELECT query_id, fold FROM placed WHERE i > 0"


def newton(name: str, rows: str, steps: int = 9) -> dict[str, str]:
    """Steps up to ``name``_fit (k, a, b, c): the logistic fit of y on x1 and x2, with a pull of one on both, over the rows outside each fold."""
    out = {f"{name}_m": f"SELECT fold, x1, x2, y, count(*) AS n FROM {rows} GROUP BY ALL", f"{name}_k": f"SELECT DISTINCT fold AS k FROM {name}_m", f"{name}_t0": f"SELECT k, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c FROM {name}_k"}
    for i in range(steps):
        sums = ", ".join(f"sum(n * p * (1 - p) * {x}){pull} AS {h}" for h, x, pull in (("h11", "x1 * x1", " + 1"), ("h12", "x1 * x2", ""), ("h13", "x1", ""), ("h22", "x2 * x2", " + 1"), ("h23", "x2", ""), ("h33", "1", "")))
        grads = "sum(n * (p - y) * x1) + any_value(a) AS g1, sum(n * (p - y) * x2) + any_value(b) AS g2, sum(n * (p - y)) AS g3"
        solved = (
            "a - (g1 * (h22 * h33 - h23 * h23) - h12 * (g2 * h33 - h23 * g3) + h13 * (g2 * h23 - h22 * g3)) / d AS a, "
            "b - (h11 * (g2 * h33 - h23 * g3) - g1 * (h12 * h33 - h23 * h13) + h13 * (h12 * g3 - g2 * h13)) / d AS b, "
            "c - (h11 * (h22 * g3 - g2 * h23) - h12 * (h12 * g3 - g2 * h13) + g1 * (h12 * h23 - h22 * h13)) / d AS c"
        )
        inner = f"SELECT k, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, {grads}, {sums} FROM (SELECT t.*, m.*, 1 / (1 + exp(-(a * x1 + b * x2 + c))) AS p FROM {name}_t{i} t JOIN {name}_m m ON m.fold <> t.k) GROUP BY k"
        out[f"{name}_t{i + 1}"] = f"SELECT k, {solved} FROM (SELECT *, h11 * (h22 * h33 - h23 * h23) - h12 * (h12 * h33 - h23 * h13) + h13 * (h12 * h23 - h22 * h13) AS d FROM ({inner}))"
    return out | {f"{name}_fit": f"SELECT * FROM {name}_t{steps}"}


_x = f'"{FIT[0]}" AS x1, "{FIT[1]}" AS x2'
STEPS |= {
    "decisive": "SELECT * FROM merged WHERE model_pref <> 0",
    "folds_decisive": folds("decisive"),
    "joint_rows": f"SELECT query_id, doc_id_1, doc_id_2, fold, {_x}, CAST(model_pref > 0 AS INTEGER) AS y FROM decisive JOIN folds_decisive USING (query_id)",
    **newton("joint", "joint_rows"),
    "joint_null": "SELECT k, sum(y) / count(*) AS q FROM joint_k JOIN joint_rows ON fold <> k GROUP BY k",
    "joint_oof": "SELECT r.*, y = 1 AS t, 1 / (1 + exp(-(a * x1 + b * x2 + c))) AS p, q FROM joint_rows r JOIN joint_fit f ON f.k = fold JOIN joint_null z ON z.k = fold",
    "joint_right": "SELECT *, (p >= 0.5) = t AS ok, (q >= 0.5) = t AS null_ok, (CASE WHEN x1 + x2 = 0 THEN q >= 0.5 ELSE x1 + x2 > 0 END) = t AS vote_ok FROM joint_oof",
    "folds_all": folds("merged"),
    "all_rows": f"SELECT query_id, doc_id_1, doc_id_2, fold, model_pref, {_x}, CAST(model_pref > 0 AS INTEGER) AS y FROM merged JOIN folds_all USING (query_id)",
    "tried_rows": "SELECT * FROM all_rows WHERE model_pref <> 0",
    **newton("tried", "tried_rows"),
    "surrogate_of": "SELECT r.*, a, b, c, 1 / (1 + exp(-(a * x1 + b * x2 + c))) AS p FROM all_rows r JOIN tried_fit ON k = fold",
    "surrogates": "SELECT *, CAST(sign(round(p - 0.5, 12)) AS INTEGER) AS pref, CAST(sign(round(1 / (1 + exp(-(b * x2 + c))) - 0.5, 12)) AS INTEGER) AS without_1, CAST(sign(round(1 / (1 + exp(-(a * x1 + c))) - 0.5, 12)) AS INTEGER) AS without_2 FROM surrogate_of",
    "surrogate_queries": f"SELECT query_id, count(*) AS pairs, avg(CAST(pref = model_pref AS INTEGER)) FILTER (model_pref <> 0) AS macro, count(*) FILTER (model_pref <> 0 AND pref = model_pref) AS good, count(*) FILTER (model_pref <> 0) AS n, sum(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) FILTER (model_pref <> 0) AS loss, count(*) FILTER (model_pref = 0) AS ties, count(*) FILTER (pref = 0) AS own, count(*) FILTER (model_pref = 0 AND pref <> 0) AS forced FROM surrogates GROUP BY query_id",
}


def area(score: str, positive: str, source: str) -> str:
    """The area under the ROC curve by ranks."""
    return f"(SELECT round((sum(r) FILTER (t) - count(*) FILTER (t) * (count(*) FILTER (t) + 1) / 2) / (count(*) FILTER (t) * count(*) FILTER (NOT t)), 6) FROM (SELECT {positive} AS t, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2 AS r FROM {source}))"
