"""Ranking metrics from one per-query table.

``per_query`` computes every measure of a run in one pass; the dialects of the
field are options: exponential or linear gain, whether grade 0 counts as
relevant, and over which queries means are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.text import clean_id
from ..plans.catalog import Catalogue, rel, withs
from .ranking import by_score, ranked

CAT = Catalogue()
queries, oracle_sql = CAT.queries, CAT.oracle_sql


def gain(rel_: Column, kind: str) -> Column:
    return F.pow(F.lit(2.0), rel_) - 1 if kind == "exp" else rel_.cast("double")


def ideal(qrels: DataFrame, ks: list[int], kind: str, by: list[str] = ["query_id"]) -> DataFrame:
    """Best possible DCG per query at each k, and the number of relevant documents."""
    r = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("relevance"), F.asc("doc_id")))
    q = qrels.withColumn("_r", r)
    return q.groupBy(*by).agg(*(F.sum(F.when(F.col("_r") <= k, gain(F.col("relevance"), kind) / F.log2(F.col("_r") + 1))).alias(f"ideal_{k}") for k in ks), F.count(F.lit(1)).alias("n_rel"))


def per_query(run: DataFrame, qrels: DataFrame, ks: list[int], kind: str = "linear", min_rel: int = 1, universe: str = "qrels") -> DataFrame:
    """(system, query_id, p_k, r_k, ndcg_k..., ap, rr) of a run (system, query_id, doc_id, score).

    ``min_rel``: the least grade that is relevant. ``universe``: ``qrels`` gives queries without
    hits zeros, ``intersect`` leaves them out. Ties of score go to the lesser id."""
    q = qrels.where(F.col("relevance") >= min_rel)
    top = ranked(run.select("system", "query_id", "doc_id", "score"), ["system", "query_id"], by_score())
    hits = top.join(q, ["query_id", "doc_id"])
    nth = F.row_number().over(Window.partitionBy("system", "query_id").orderBy("rank"))
    hits = hits.withColumn("nth", nth)
    cols = []
    for k in ks:
        within = F.col("rank") <= k
        cols += [F.count_if(within).alias(f"h_{k}"), F.sum(F.when(within, gain(F.col("relevance"), kind) / F.log2(F.col("rank") + 1))).alias(f"dcg_{k}")]
    agg = hits.groupBy("system", "query_id").agg(*cols, F.sum(F.col("nth") / F.col("rank")).alias("ap"), F.min("rank").alias("first"))
    best = ideal(q, ks, kind)
    systems = run.select("system", "query_id").distinct()
    if universe == "qrels":
        names = systems.agg(F.collect_set("system").alias("s"))  # one row: systems are compared by name
        systems = best.select("query_id").crossJoin(F.broadcast(names)).select("query_id", F.explode("s").alias("system"))
    full = systems.join(best, "query_id").join(agg, ["system", "query_id"], "left")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    out = []
    for k in ks:
        out += [z(F.col(f"h_{k}") / k).alias(f"p_{k}"), z(F.col(f"h_{k}") / F.col("n_rel")).alias(f"r_{k}"), z(F.try_divide(F.col(f"dcg_{k}"), F.col(f"ideal_{k}"))).alias(f"ndcg_{k}")]
    return full.select("system", "query_id", *out, z(F.col("ap") / F.col("n_rel")).alias("ap"), z(1 / F.col("first")).alias("rr"))


def means(per: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    names = [c for c in per.columns if c not in {*by, "query_id", "system"}]
    return per.groupBy(*by).agg(*(F.round(F.avg(c), digits).alias(c) for c in names), F.count(F.lit(1)).alias("n_queries"))


def _sql(ks: list[int], kind: str = "linear", min_rel: int = 1, universe: str = "qrels") -> str:
    g = "(2 ** relevance - 1)" if kind == "exp" else "relevance::DOUBLE"
    parts = ", ".join(f"count(*) FILTER (WHERE rank <= {k}) AS h_{k}, sum(CASE WHEN rank <= {k} THEN {g} / log2(rank + 1) END) AS dcg_{k}" for k in ks)
    best = ", ".join(f"sum(CASE WHEN r <= {k} THEN {g} / log2(r + 1) END) AS ideal_{k}" for k in ks)
    out = ", ".join(f"coalesce(h_{k}::DOUBLE / {k}, 0) AS p_{k}, coalesce(h_{k}::DOUBLE / n_rel, 0) AS r_{k}, coalesce(dcg_{k} / nullif(ideal_{k}, 0), 0) AS ndcg_{k}" for k in ks)
    uni = "SELECT s.system, b.query_id FROM best b CROSS JOIN (SELECT DISTINCT system FROM scored) s" if universe == "qrels" else "SELECT DISTINCT system, query_id FROM scored"
    return (
        withs("scored", "qrels")
        + f""", rq AS (SELECT * FROM qrels WHERE relevance >= {min_rel}), tops AS (SELECT *, row_number() OVER (PARTITION BY system, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored),
hits AS (SELECT t.system, t.query_id, t.rank, q.relevance, row_number() OVER (PARTITION BY t.system, t.query_id ORDER BY t.rank) AS nth FROM tops t JOIN rq q USING (query_id, doc_id)),
agg AS (SELECT system, query_id, {parts}, sum(nth::DOUBLE / rank) AS ap, min(rank) AS first FROM hits GROUP BY 1, 2),
best AS (SELECT query_id, {best}, count(*) AS n_rel FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS r FROM rq) GROUP BY 1),
uni AS ({uni}), per AS (SELECT u.system, u.query_id, {out}, coalesce(ap / n_rel, 0) AS ap, coalesce(1.0::DOUBLE / first, 0) AS rr FROM uni u JOIN best b USING (query_id) LEFT JOIN agg a USING (system, query_id))
"""
    )


def _means(ks: list[int], by: str = "system", extra: str = "") -> str:
    cols = [f"{m}_{k}" for k in ks for m in ("p", "r", "ndcg")] + ["ap", "rr"]
    return f"SELECT {by}, {', '.join(f'round(avg({c}), 6) AS {c}' for c in cols)}, count(*) AS n_queries FROM per {extra} GROUP BY {by}"


def _metric(name: str, ks, kind, min_rel, universe):
    @CAT.query(name, _sql(ks, kind, min_rel, universe) + _means(ks))
    def _f(spark, d):
        return means(per_query(rel(spark, d, "scored"), rel(spark, d, "qrels"), ks, kind, min_rel, universe), ["system"])


_metric("met_all", [1, 3, 10], "exp", 1, "intersect")
_metric("met_tier1", [10, 50, 100], "linear", 0, "qrels")
_metric("met_agent", [5, 10], "linear", 1, "qrels")
_metric("met_graded_0", [10], "exp", 0, "intersect")


@CAT.query("met_precision", _sql([3]) + "SELECT system, query_id, round(p_3, 6) AS precision_3 FROM per")
def _precision(spark, d):
    return per_query(rel(spark, d, "scored"), rel(spark, d, "qrels"), [3]).select("system", "query_id", F.round("p_3", 6).alias("precision_3"))


@CAT.query("met_recall", _sql([3]) + "SELECT system, query_id, round(r_3, 6) AS recall_3 FROM per")
def _recall(spark, d):
    return per_query(rel(spark, d, "scored"), rel(spark, d, "qrels"), [3]).select("system", "query_id", F.round("r_3", 6).alias("recall_3"))


@CAT.query("met_ndcg", _sql([5], "exp") + "SELECT system, query_id, round(ndcg_5, 6) AS ndcg_5 FROM per")
def _ndcg(spark, d):
    return per_query(rel(spark, d, "scored"), rel(spark, d, "qrels"), [5], "exp").select("system", "query_id", F.round("ndcg_5", 6).alias("ndcg_5"))


@CAT.query("win_running_hits", _sql([10]) + "SELECT system, query_id, round(ap, 6) AS average_precision FROM per")
def _ap(spark, d):
    return per_query(rel(spark, d, "scored"), rel(spark, d, "qrels"), [10]).select("system", "query_id", F.round("ap", 6).alias("average_precision"))


@CAT.query("win_first_rel", _sql([10]) + "SELECT system, query_id, round(rr, 6) AS reciprocal_rank FROM per")
def _rr(spark, d):
    return per_query(rel(spark, d, "scored"), rel(spark, d, "qrels"), [10]).select("system", "query_id", F.round("rr", 6).alias("reciprocal_rank"))


@CAT.query("met_domain", _sql([10]).replace("WITH ", "WITH ", 1) + ", qd AS (SELECT clean_id(_id) AS query_id, min(coalesce(domain, 'unknown')) AS domain FROM queries GROUP BY 1), px AS (SELECT per.*, coalesce(domain, 'unknown') AS domain FROM per LEFT JOIN qd USING (query_id)) " + _means([10], "system, domain").replace("FROM per", "FROM px"))
def _domain(spark, d):
    per = per_query(rel(spark, d, "scored"), rel(spark, d, "qrels"), [10]).join(rel(spark, d, "q_domain"), "query_id", "left").withColumn("domain", F.coalesce("domain", F.lit("unknown")))
    return means(per, ["system", "domain"])


def _typed(name: str, kind: str):
    sql = _sql([10]).replace("rq AS (SELECT * FROM qrels WHERE relevance >= 1)", f"dt AS (SELECT clean_id(_id) AS doc_id, min(doc_type) AS doc_type FROM corpus WHERE doc_type IS NOT NULL GROUP BY 1), rq AS (SELECT q.* FROM qrels q LEFT JOIN dt USING (doc_id) WHERE relevance >= 1 AND coalesce(doc_type, 'paper') = '{kind}')")

    @CAT.query(name, sql + _means([10]))
    def _f(spark, d):
        q = rel(spark, d, "qrels").join(rel(spark, d, "doc_types"), "doc_id", "left").where(F.coalesce("doc_type", F.lit("paper")) == kind).drop("doc_type")
        return means(per_query(rel(spark, d, "scored"), q, [10]), ["system"])


_typed("met_doc_type_paper", "paper")
_typed("met_doc_type_patent", "patent")

_J = "CASE WHEN regexp_matches({c}, '^(US|EP|WO)[0-9]') THEN substr({c}, 1, 2) WHEN starts_with({c}, 'W') THEN 'paper' ELSE 'other' END"


def jurisdiction(c: str) -> Column:
    return F.when(F.col(c).rlike("^(US|EP|WO)[0-9]"), F.substring(c, 1, 2)).when(F.col(c).startswith("W"), "paper").otherwise("other")


def found_within(spark, d, k: int) -> DataFrame:
    """Each relevant pair and system, and whether the system has it among its first k."""
    s = rel(spark, d, "scored")
    top = ranked(s, ["system", "query_id"], by_score(), k).select("system", "query_id", "doc_id", F.lit(True).alias("hit"))
    names = s.agg(F.collect_set("system").alias("s"))
    q = rel(spark, d, "qrels").where("relevance >= 1").crossJoin(F.broadcast(names)).select("query_id", "doc_id", "relevance", F.explode("s").alias("system"))
    return q.join(top, ["system", "query_id", "doc_id"], "left").withColumn("found", F.coalesce("hit", F.lit(False))).drop("hit")


@CAT.query("met_by_grade", _sql([10]) + ", t AS (SELECT system, query_id, doc_id, row_number() OVER (PARTITION BY system, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored) SELECT s.system, q.relevance, count(*) AS total, count(*) FILTER (WHERE t.rank <= 3) AS hits FROM rq q CROSS JOIN (SELECT DISTINCT system FROM scored) s LEFT JOIN t ON t.system = s.system AND t.query_id = q.query_id AND t.doc_id = q.doc_id GROUP BY 1, 2")
def _by_grade(spark, d):
    return found_within(spark, d, 3).groupBy("system", "relevance").agg(F.count(F.lit(1)).alias("total"), F.count_if("found").alias("hits"))


@CAT.query("abl_ipc", _sql([10]) + ", m AS (SELECT DISTINCT clean_id(_id) AS query_id, substr(c, 1, 3) AS ipc3 FROM (SELECT _id, unnest(ipc_codes) AS c FROM queries)), g AS (SELECT system, ipc3, per.* EXCLUDE (system) FROM per JOIN m USING (query_id)) SELECT system, ipc3, count(*) AS n_queries, round(avg(ndcg_10), 6) AS ndcg_10, round(avg(r_10), 6) AS r_10 FROM g GROUP BY 1, 2 HAVING count(*) >= 10")
def _ipc(spark, d):
    from ..sources.tables import table

    m = table(spark, d, "queries").select(clean_id("_id").alias("query_id"), F.explode("ipc_codes").alias("c")).select("query_id", F.substring("c", 1, 3).alias("ipc3")).distinct()
    per = per_query(rel(spark, d, "scored"), rel(spark, d, "qrels"), [10]).join(m, "query_id")
    return per.groupBy("system", "ipc3").agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("ndcg_10"), 6).alias("ndcg_10"), F.round(F.avg("r_10"), 6).alias("r_10")).where("n_queries >= 10")


@CAT.query("abl_time", _sql([10]) + ", t AS (SELECT clean_id(_id) AS query_id, max(parse_day(priority_date)) AS p FROM queries GROUP BY 1) SELECT system, CASE WHEN p >= DATE '2010-01-01' THEN 'newer' ELSE 'older' END AS age, count(*) AS n_queries, round(avg(ndcg_10), 6) AS ndcg_10 FROM per LEFT JOIN t USING (query_id) GROUP BY 1, 2")
def _time(spark, d):
    from ..sources.tables import table

    t = table(spark, d, "queries").groupBy(clean_id("_id").alias("query_id")).agg(F.max(parse_date(F.col("priority_date"))).alias("p"))
    per = per_query(rel(spark, d, "scored"), rel(spark, d, "qrels"), [10]).join(t, "query_id", "left")
    age = F.when(F.col("p") >= F.lit("2010-01-01").cast("date"), "newer").otherwise("older")
    return per.groupBy("system", age.alias("age")).agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("ndcg_10"), 6).alias("ndcg_10"))


#: Depths of the micro recalls.
DEPTHS = (10, 50, 100)


def placed(spark, d) -> DataFrame:
    """Relevant pairs of the queries each system answers, with the system's ``rank`` of the document or null."""
    s = rel(spark, d, "scored")
    top = ranked(s, ["system", "query_id"], by_score(), max(DEPTHS)).select("system", "query_id", "doc_id", "rank")
    asked = s.select("system", "query_id").distinct().join(rel(spark, d, "qrels").where("relevance >= 1"), "query_id")
    return asked.join(top, ["system", "query_id", "doc_id"], "left")


_PLACED = _sql([10]) + ", x AS (SELECT s.system, q.query_id, q.doc_id, q.relevance, t.rank FROM (SELECT DISTINCT system, query_id FROM scored) s JOIN rq q USING (query_id) LEFT JOIN tops t USING (system, query_id, doc_id))"


def _micro(where: str = "true") -> str:
    return ", ".join(f"count(*) FILTER (WHERE rank <= {k} AND {where}) AS hits_{k}, round(coalesce(count(*) FILTER (WHERE rank <= {k} AND {where})::DOUBLE / nullif(count(*) FILTER (WHERE {where}), 0), 0), 6) AS recall_{k}" for k in DEPTHS)


def micro() -> list[Column]:
    return [c for k in DEPTHS for c in (F.count_if(F.col("rank") <= k).alias(f"hits_{k}"), F.round(F.coalesce(F.try_divide(F.count_if(F.col("rank") <= k).cast("double"), F.count(F.lit(1)).cast("double")), F.lit(0.0)), 6).alias(f"recall_{k}"))]


@CAT.query("met_jurisdiction", _PLACED + f" SELECT system, {_J.format(c='doc_id')} AS jurisdiction, count(*) AS total, {_micro()} FROM x GROUP BY 1, 2")
def _jurisdictions(spark, d):
    return placed(spark, d).groupBy("system", jurisdiction("doc_id").alias("jurisdiction")).agg(F.count(F.lit(1)).alias("total"), *micro())


@CAT.query("met_jur_matrix", _PLACED + f" SELECT {_J.format(c='query_id')} AS query_jurisdiction, {_J.format(c='doc_id')} AS doc_jurisdiction, count(*) AS total, {_micro()} FROM x GROUP BY CUBE (1, 2)")
def _matrix(spark, d):
    """Hits and totals by the places of query and document, and the distribution over either alone (null: all)."""
    x = placed(spark, d).select(jurisdiction("query_id").alias("query_jurisdiction"), jurisdiction("doc_id").alias("doc_jurisdiction"), "rank")
    return x.cube("query_jurisdiction", "doc_jurisdiction").agg(F.count(F.lit(1)).alias("total"), *micro())


@CAT.query("met_cross_type", _PLACED + ", dt AS (SELECT clean_id(_id) AS doc_id, min(doc_type) AS doc_type FROM corpus WHERE doc_type IS NOT NULL AND _id IS NOT NULL GROUP BY 1), y AS (SELECT x.*, coalesce(doc_type, 'paper') AS kind, k FROM x LEFT JOIN dt USING (doc_id), (SELECT unnest([10, 50, 100]) AS k)), r AS (SELECT system, k, coalesce(count(*) FILTER (WHERE rank <= k AND kind = 'paper')::DOUBLE / nullif(count(*) FILTER (WHERE kind = 'paper'), 0), 0) AS a, coalesce(count(*) FILTER (WHERE rank <= k AND kind = 'patent')::DOUBLE / nullif(count(*) FILTER (WHERE kind = 'patent'), 0), 0) AS b FROM y GROUP BY 1, 2) SELECT system, k, round(a, 6) AS paper_recall, round(b, 6) AS patent_recall, CASE WHEN b > 0 THEN round(a / b, 6) ELSE 'inf'::DOUBLE END AS bias FROM r")
def _cross(spark, d):
    """Micro recall by type of document at each depth, and their ratio; infinite where no patent is found."""
    x = placed(spark, d).join(rel(spark, d, "doc_types"), "doc_id", "left").withColumn("t", F.coalesce("doc_type", F.lit("paper")))
    z = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    part = lambda kind, k: z(F.count_if((F.col("rank") <= k) & (F.col("t") == kind)), F.count_if(F.col("t") == kind))
    g = x.groupBy("system").agg(*(part(kind, k).alias(f"{kind}{k}") for kind in ("paper", "patent") for k in DEPTHS))
    row = lambda k: F.struct(F.lit(k).alias("k"), F.col(f"paper{k}").alias("a"), F.col(f"patent{k}").alias("b"))
    r = g.select("system", F.inline(F.array(*(row(k) for k in DEPTHS))))
    return r.select("system", "k", F.round("a", 6).alias("paper_recall"), F.round("b", 6).alias("patent_recall"), F.when(F.col("b") > 0, F.round(F.col("a") / F.col("b"), 6)).otherwise(F.lit(float("inf"))).alias("bias"))
