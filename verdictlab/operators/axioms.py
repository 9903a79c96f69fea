"""Retrieval axioms: for a pair of documents, 1 prefers the first, -1 the second, 0 neither.

Every document of a pair is described once a query by arrays in the order of the query's sorted terms; the axioms are expressions over two such
descriptions, so that pairs cost one join a side and no further shuffle. Axioms that the source library defines elsewhere follow the published
formulas, as far as those are definite; PROX2 to PROX5, LB1, STMC and REG are approximations of theirs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictlab.functions.text import tokens
from verdictlab.sources.index import Index
from verdictlab.sources.retrieval import query_terms
from verdictlab.sources.staging import staged


def query_side(topics: DataFrame, index: Index) -> DataFrame:
    """qid, terms (sorted), qtf, idf (arrays by term), phrase (the query's words with a space around)."""
    terms = query_terms(topics, index.tokenize)
    # a term that no document holds is the rarest
    never = F.log(1 + F.lit((index.size[0] + 0.5) / 0.5))
    rows = terms.join(index.idf().select("term", "idf"), "term", "left").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("term", "qtf", F.round(F.coalesce("idf", never), 9).alias("idf")))).alias("t"))
    words = topics.select("qid", F.concat(F.lit(" "), F.array_join(index.tokenize(F.col("query")), " "), F.lit(" ")).alias("phrase"))
    return rows.join(words, "qid").select("qid", F.col("t.term").alias("terms"), F.col("t.qtf").alias("qtf"), F.col("t.idf").alias("idf"), "phrase")


def document_side(pool: DataFrame, queries: DataFrame, corpus: DataFrame, index: Index, windows: bool = True) -> DataFrame:
    """qid, docno, d: dl, n_unique, score, tf and first position (-1: none) by the query's terms, total, n_cov, mask, phrase_at, other, mean.

    Positions come from the index's postings of the pool's documents, staged once. ``windows`` off leaves other and mean null.
    """
    wanted = pool.select("docno").distinct()
    texts = corpus.join(wanted, "docno", "left_semi")
    terms = queries.select("qid", F.explode("terms").alias("term"))
    found = staged(index.matches(terms).join(wanted, "docno", "left_semi").select("docno", "term", "tf", "first", "places"), "found")
    each = pool.select("qid", "docno", "score").join(terms, "qid").join(found, ["docno", "term"], "left")
    entry = F.struct("term", F.coalesce("tf", F.lit(0)).cast("long").alias("tf"), F.coalesce("first", F.lit(-1)).cast("long").alias("first"))
    docs = each.groupBy("qid", "docno").agg(F.first("score").alias("score"), F.sort_array(F.collect_list(entry)).alias("t"))
    docs = docs.select("qid", "docno", "score", F.col("t.tf").alias("tf"), F.col("t.first").alias("first"))
    if windows:
        docs = docs.join(cover(found, each.select("qid", "docno", "term"), terms), ["qid", "docno"], "left")
    else:
        docs = docs.withColumns({"other": F.lit(None).cast("long"), "mean": F.lit(None).cast("double")})
    shape = texts.select("docno", F.concat(F.lit(" "), F.array_join(index.tokenize(F.col("text")), " "), F.lit(" ")).alias("joined")).join(index.documents, "docno")
    docs = docs.join(shape, "docno").join(queries.select("qid", "phrase"), "qid")
    at = F.expr("locate(phrase, joined)")
    before = F.expr("substr(joined, 1, locate(phrase, joined) - 1)")
    fields = {
        "dl": F.col("dl"),
        "n_unique": F.col("n_unique"),
        "score": F.col("score"),
        "tf": F.col("tf"),
        "first": F.col("first"),
        "total": F.expr("aggregate(tf, 0L, (a, x) -> a + x)"),
        "n_cov": F.expr("CAST(size(filter(tf, x -> x > 0)) AS BIGINT)"),
        "mask": F.expr("array_join(transform(tf, x -> IF(x > 0, '1', '0')), '')"),
        "phrase_at": F.when(at > 0, F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))).cast("long"),
        "other": F.col("other"),
        "mean": F.col("mean"),
    }
    return docs.select("qid", "docno", F.struct(*[v.alias(k) for k, v in fields.items()]).alias("d"))


def cover(found: DataFrame, wanted: DataFrame, terms: DataFrame) -> DataFrame:
    """qid, docno, other (words besides query terms in the shortest window with all query terms), mean (length of the windows that begin at each).

    Where each term comes next is a running minimum from the document's end: linear in the positions of query terms.
    """
    hits = found.join(wanted, ["docno", "term"]).select("qid", "docno", "term", F.explode("places").alias("pos"))
    starts = hits.select("qid", "docno", "pos").distinct().withColumn("idx", F.row_number().over(Window.partitionBy("qid", "docno").orderBy("pos")))
    grid = starts.join(terms, "qid").join(hits.withColumn("hit", F.lit(True)), ["qid", "docno", "term", "pos"], "left")
    ahead = Window.partitionBy("qid", "docno", "term").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.withColumn("next", F.min(F.when(F.col("hit"), F.struct("pos", "idx"))).over(ahead))
    every = grid.groupBy("qid", "docno", "pos", "idx").agg(F.max("next").alias("e"), F.count_if(F.col("next").isNull()).alias("missing")).filter("missing = 0")
    every = every.select("qid", "docno", (F.col("e.pos") - F.col("pos") + 1).cast("long").alias("n"), (F.col("e.idx") - F.col("idx") + 1).cast("long").alias("inside"))
    return every.groupBy("qid", "docno").agg(F.min(F.struct("n", (F.col("n") - F.col("inside")).alias("other")))["other"].alias("other"), F.round(F.avg("n"), 9).alias("mean"))


_N = "sequence(0, size(terms) - 1)"
_PAIRS = f"filter(flatten(transform({_N}, i -> transform({_N}, j -> struct(i AS i, j AS j)))), x -> x.i < x.j)"


def _close(a: str, b: str, rel: float) -> str:
    return f"(abs({a} - {b}) <= {rel}D * greatest(abs({a}), abs({b})))"


def _sign(a: str, b: str) -> str:
    return f"CAST(sign({a} - {b}) AS INT)"


def _gate(condition: str, value: str) -> str:
    return f"CASE WHEN {condition} THEN coalesce({value}, 0) ELSE 0 END"


def _points(condition: str, over: str, x: str = "i") -> str:
    return f"size(filter({over}, {x} -> {condition}))"


def _tf_lnc(m: float) -> str:
    near = _close("(d1.dl - d1.tf[i])", "(d2.dl - d2.tf[i])", m)
    return _sign(_points(f"{near} AND d1.tf[i] > d2.tf[i]", _N), _points(f"{near} AND d2.tf[i] > d1.tf[i]", _N))


def _m_tdc(m: float) -> str:
    # x.a is the term with the greater idf
    pairs = f"transform(filter({_PAIRS}, x -> NOT {_close('idf[x.i]', 'idf[x.j]', 1e-9)}), x -> IF(idf[x.i] < idf[x.j], struct(x.j AS a, x.i AS b), struct(x.i AS a, x.j AS b)))"
    swapped = "(d1.tf[x.a] = d2.tf[x.b] AND d1.tf[x.b] = d2.tf[x.a])"
    valid = f"({swapped} OR qtf[x.a] >= qtf[x.b])"
    gate = f"{_close('d1.total', 'd2.total', m)} AND d1.tf <> d2.tf"
    return _gate(gate, _sign(_points(f"{valid} AND d1.tf[x.a] > d2.tf[x.a]", pairs, "x"), _points(f"{valid} AND d1.tf[x.a] < d2.tf[x.a]", pairs, "x")))


def _tfc3(one: str, two: str) -> str:
    def held(a: str, b: str) -> str:
        return f"({one}.tf[x.i] > 0 AND {one}.tf[x.j] > 0 AND {two}.tf[x.{a}] = {one}.tf[x.i] + {one}.tf[x.j] AND {two}.tf[x.{b}] = 0)"

    return _points(f"{_close('idf[x.i]', 'idf[x.j]', 1e-9)} AND ({held('i', 'j')} OR {held('j', 'i')})", _PAIRS, "x")


def _prox1(d: str) -> str:
    inner = f"IF({d}.first[x.i] >= 0 AND {d}.first[x.j] >= 0, greatest(abs({d}.first[x.i] - {d}.first[x.j]) - 1, 0L), 0L)"
    return f"aggregate(transform({_PAIRS}, x -> {inner}), 0L, (a, x) -> a + x)"


_LEN = _close("d1.dl", "d2.dl", 0.1)
_SAME = "d1.mask = d2.mask"
_ALL = "(d1.n_cov = size(terms) AND d2.n_cov = size(terms))"
_far = "9223372036854775807L"
_jaccard = lambda d: f"{d}.n_cov / CAST(size(terms) + {d}.n_unique - {d}.n_cov AS DOUBLE)"

#: Axioms by column name; arrays are d1.x and d2.x, terms, qtf, idf.
AXIOMS: dict[str, str] = {
    "TFC1": _gate(_LEN, _sign("d1.total", "d2.total")),
    "TFC1_len0_2": _gate(_close("d1.dl", "d2.dl", 0.2), _sign("d1.total", "d2.total")),
    "TFC3": _gate(_LEN, _sign(_tfc3("d1", "d2"), _tfc3("d2", "d1"))),
    "M_TDC": _m_tdc(0.0),
    "M_TDC_R": _m_tdc(0.1),
    "LNC1": _gate(f"forall({_N}, i -> {_close('d1.tf[i]', 'd2.tf[i]', 0.1)})", _sign("d2.dl", "d1.dl")),
    "TF_LNC": _tf_lnc(0.0),
    "TF_LNC_R": _tf_lnc(0.1),
    "PROX1": _gate(_SAME, _sign(_prox1("d2"), _prox1("d1"))),
    "PROX2": _gate(_SAME, _sign(*(f"aggregate(filter({d}.first, x -> x >= 0), 0L, (a, x) -> a + x)" for d in ("d2", "d1")))),
    "PROX3": f"CAST(CASE WHEN coalesce(d1.phrase_at, {_far}) < coalesce(d2.phrase_at, {_far}) THEN 1 WHEN coalesce(d1.phrase_at, {_far}) > coalesce(d2.phrase_at, {_far}) THEN -1 ELSE 0 END AS INT)",
    "PROX4": _gate(_ALL, _sign("d2.other", "d1.other")),
    "PROX5": _gate(_ALL, _sign("d2.mean", "d1.mean")),
    "AND_": "CAST(CAST(d1.n_cov = size(terms) AS INT) - CAST(d2.n_cov = size(terms) AS INT) AS INT)",
    "DIV": _sign(f"round({_jaccard('d2')}, 9)", f"round({_jaccard('d1')}, 9)"),
    "LB1": _gate(_close("d1.score", "d2.score", 0.1), _sign(_points("d1.tf[i] > 0 AND d2.tf[i] = 0", _N), _points("d2.tf[i] > 0 AND d1.tf[i] = 0", _N))),
    "VERB": _gate(_SAME, _sign("d1.dl", "d2.dl")),
    "VERB_R": _gate(_close("d1.n_cov", "d2.n_cov", 0.1), _sign("d1.dl", "d2.dl")),
    "QCOV": _sign("d1.n_cov", "d2.n_cov"),
}


def with_margin(name: str, margin: float) -> str:
    """The expression of a length-gated or relaxed axiom at another margin."""
    if name == "TFC1":
        return _gate(_close("d1.dl", "d2.dl", margin), _sign("d1.total", "d2.total"))
    if name == "TFC3":
        return _gate(_close("d1.dl", "d2.dl", margin), _sign(_tfc3("d1", "d2"), _tfc3("d2", "d1")))
    if name in ("TF_LNC", "TF_LNC_R"):
        return _tf_lnc(margin)
    if name in ("M_TDC", "M_TDC_R"):
        return _m_tdc(margin)
    if name == "LNC1":
        return _gate(f"forall({_N}, i -> {_close('d1.tf[i]', 'd2.tf[i]', margin)})", _sign("d2.dl", "d1.dl"))
    if name == "VERB_R":
        return _gate(_close("d1.n_cov", "d2.n_cov", margin), _sign("d1.dl", "d2.dl"))
    raise ValueError(f"{name} has no margin")


def axiom_frame(pool: DataFrame, pairs: DataFrame, topics: DataFrame, corpus: DataFrame, index: Index, windows: bool = True) -> DataFrame:
    """qid, doc_id_1, doc_id_2 with both descriptions and the query's arrays."""
    queries = staged(query_side(topics, index), "queries")
    used = pairs.select("qid", F.col("doc_id_1").alias("docno")).union(pairs.select("qid", F.col("doc_id_2").alias("docno"))).distinct()
    docs = staged(document_side(pool.join(used, ["qid", "docno"], "left_semi"), queries, corpus, index, windows), "described")  # read for both sides; its size follows the pool
    one = docs.select("qid", F.col("docno").alias("doc_id_1"), F.col("d").alias("d1"))
    two = docs.select("qid", F.col("docno").alias("doc_id_2"), F.col("d").alias("d2"))
    return pairs.join(one, ["qid", "doc_id_1"]).join(two, ["qid", "doc_id_2"]).join(queries, "qid")


def axiom_preferences(pool: DataFrame, pairs: DataFrame, topics: DataFrame, corpus: DataFrame, names: list[str] | None = None, index: Index | None = None) -> DataFrame:
    """qid, doc_id_1, doc_id_2 and a column an axiom. The index (by default one of ``corpus``) also says how texts become terms."""
    unknown = set(names or ()) - set(AXIOMS)
    if unknown:
        raise ValueError(f"unknown axioms: {sorted(unknown)}")
    frame = axiom_frame(pool, pairs, topics, corpus, index or Index.of(corpus), windows=not names or bool({"PROX4", "PROX5"} & set(names)))
    return frame.select("qid", "doc_id_1", "doc_id_2", *[F.expr(AXIOMS[n]).cast("int").alias(n) for n in names or AXIOMS])


# ---- similarity of terms


def trigrams(term: Column) -> Column:
    padded = F.concat(F.lit("#"), term, F.lit("#"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def similarity(a: Column, b: Column) -> Column:
    """The Jaccard similarity of two terms' trigrams: the default where no vectors are given."""
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(x, y))
    return both / (F.size(x) + F.size(y) - both)


Similarity = Callable[[Column, Column], Column]


def regularity(topics: DataFrame, similar: Similarity = similarity, tokenize: Callable[[Column], Column] = tokens) -> DataFrame:
    """qid, least, most: the query's terms with the least and greatest mean similarity to its others (ties: the first by name)."""
    t = topics.select("qid", F.explode(F.array_distinct(tokenize(F.col("query")))).alias("term"))
    a, b = t.alias("a"), t.alias("b")
    both = a.join(b, (F.col("a.qid") == F.col("b.qid")) & (F.col("a.term") != F.col("b.term"))).select(F.col("a.qid").alias("qid"), F.col("a.term").alias("term"), similar(F.col("a.term"), F.col("b.term")).alias("s"))
    mean = both.groupBy("qid", "term").agg(F.round(F.avg("s"), 9).alias("s"))
    return mean.groupBy("qid").agg(F.min(F.struct("s", "term"))["term"].alias("least"), F.min(F.struct((-F.col("s")).alias("s"), "term"))["term"].alias("most"))


def semantic_preferences(pool: DataFrame, pairs: DataFrame, topics: DataFrame, corpus: DataFrame, index: Index | None = None, similar: Similarity = similarity) -> DataFrame:
    """By a similarity of terms (any expression over two columns): STMC1 (greater mean similarity of query terms and document terms), STMC2 (an exact match beats similar terms only), REG and ANTI_REG."""
    used = pairs.select("qid", F.col("doc_id_1").alias("docno")).union(pairs.select("qid", F.col("doc_id_2").alias("docno"))).distinct()
    index = index or Index.of(corpus)
    terms = query_terms(topics, index.tokenize).select("qid", "term")
    docs = used.join(corpus, "docno").select("qid", "docno", F.explode(F.array_distinct(index.tokenize(F.col("text")))).alias("word"))
    # a term and a word are compared once, however many documents bring them together
    met = staged(docs.join(terms, "qid").select("qid", "docno", "term", "word"), "met")
    alike = staged(met.select("term", "word").distinct().withColumn("s", similar(F.col("term"), F.col("word"))), "alike")
    each = met.join(alike, ["term", "word"])
    sims = each.groupBy("qid", "docno").agg(F.round(F.avg("s"), 9).alias("mean"), F.count_if(F.col("s") == 1).alias("exact"), F.count_if((F.col("s") >= 0.4) & (F.col("s") < 1)).alias("similar"))
    reg = regularity(topics, similar, index.tokenize)
    tf = index.matches(terms).select("docno", "term", "tf")
    pick = lambda c: used.join(reg, "qid").select("qid", "docno", F.col(c).alias("term")).join(tf, ["docno", "term"]).select("qid", "docno", F.col("tf").alias(c))
    side = sims.join(pick("least"), ["qid", "docno"], "left").join(pick("most"), ["qid", "docno"], "left").select("qid", "docno", F.struct("mean", "exact", "similar", F.coalesce("least", F.lit(0)).alias("least"), F.coalesce("most", F.lit(0)).alias("most")).alias("d"))
    one = side.select("qid", F.col("docno").alias("doc_id_1"), F.col("d").alias("d1"))
    two = side.select("qid", F.col("docno").alias("doc_id_2"), F.col("d").alias("d2"))
    sign = lambda f: F.signum(F.col(f"d1.{f}") - F.col(f"d2.{f}")).cast("int")
    matched = lambda a, b: (F.col(f"{a}.exact") > 0) & (F.col(f"{b}.exact") == 0) & (F.col(f"{b}.similar") > 0)
    stmc2 = F.when(matched("d1", "d2"), 1).when(matched("d2", "d1"), -1).otherwise(0)
    return pairs.join(one, ["qid", "doc_id_1"]).join(two, ["qid", "doc_id_2"]).select("qid", "doc_id_1", "doc_id_2", sign("mean").alias("STMC1"), stmc2.alias("STMC2"), sign("least").alias("REG"), sign("most").alias("ANTI_REG"))


def add_missing(existing: DataFrame, names: list[str], pool: DataFrame, topics: DataFrame, corpus: DataFrame, index: Index | None = None) -> DataFrame:
    """``existing`` axiom preferences with the columns of ``names`` that they lack; rows and old columns stay as they are."""
    from verdictlab.operators.pairs import PAIR, exact_join

    lacking = [n for n in names if n not in existing.columns]
    if not lacking:
        return existing
    new = axiom_preferences(pool, existing.select(*PAIR), topics, corpus, lacking, index)
    return exact_join(existing, new, list(PAIR)).select(*existing.columns, *lacking)


def majority(names: list[str]) -> Column:
    """The sign of the sum of axiom columns."""
    return F.signum(sum((F.col(n) for n in names[1:]), F.col(names[0]))).cast("int")
