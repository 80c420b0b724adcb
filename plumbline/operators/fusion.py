"""Fusion of several rankings. A run is (system, query_id, doc_id, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import Catalogue, rel, withs
from .ranking import by_score, min_max, ranked

CAT = Catalogue()
queries, oracle_sql = CAT.queries, CAT.oracle_sql


def reciprocal_rank(run: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, doc_id, score): sum over systems of 1 / (k + rank)."""
    r = ranked(run, ["system", "query_id"], by_score())
    return r.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (F.lit(float(k)) + F.col("rank"))).alias("score"))


def linear(run: DataFrame, weights: dict[str, float] | None = None, both: bool = False) -> DataFrame:
    """Sum of min-max scores, weighted by system if weights are given; ``both`` keeps only
    documents that every system of the query has."""
    w = F.lit(1.0)
    for name, x in (weights or {}).items():
        w = F.when(F.col("system") == name, F.lit(float(x))).otherwise(w)
    out = min_max(run).groupBy("query_id", "doc_id").agg(F.sum(F.col("score") * w).alias("score"), F.count(F.lit(1)).alias("_n"))
    if both:
        n = run.groupBy("query_id").agg(F.count_distinct("system").alias("_s"))
        out = out.join(n, "query_id").where("_n = _s").drop("_s")
    return out.drop("_n")


def rounded_top(fused: DataFrame, k: int) -> DataFrame:
    return ranked(fused, ["query_id"], by_score(), k).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


_R = ", r AS (SELECT *, row_number() OVER (PARTITION BY system, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored), m AS (SELECT system, query_id, doc_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM scored WINDOW w AS (PARTITION BY system, query_id))"
_TOP = " SELECT * FROM (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM f) WHERE rank <= {k}"


@CAT.query("fus_rrf", withs("scored") + _R + ", f AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM r GROUP BY 1, 2)" + _TOP.format(k=10))
def _rrf(spark, d):
    return rounded_top(reciprocal_rank(rel(spark, d, "scored")), 10)


@CAT.query("fus_linear", withs("scored") + _R + ", f AS (SELECT query_id, doc_id, sum(s) AS score FROM m GROUP BY 1, 2)" + _TOP.format(k=10))
def _linear(spark, d):
    return rounded_top(linear(rel(spark, d, "scored")), 10)


@CAT.query("fus_weighted", withs("scored") + _R + ", f AS (SELECT query_id, doc_id, sum(s * CASE system WHEN 'alder' THEN 0.5::DOUBLE WHEN 'dune' THEN 0.3 ELSE 0.2 END) AS score FROM m GROUP BY 1, 2)" + _TOP.format(k=10))
def _weighted(spark, d):
    s = rel(spark, d, "scored")
    w = {x: 0.2 for x in ("brine", "cobalt", "ember", "fjord")} | {"alder": 0.5, "dune": 0.3}
    return rounded_top(linear(s, w), 10)


@CAT.query("fus_linear_pair", withs("scored").replace("length(system ||", "system IN ('alder', 'dune') AND length(system ||") + _R + ", n AS (SELECT query_id, count(DISTINCT system) AS k FROM scored GROUP BY 1), f AS (SELECT m.query_id, doc_id, sum(s) AS score FROM m JOIN n USING (query_id) GROUP BY 1, 2, k HAVING count(*) = k)" + _TOP.format(k=10))
def _pair(spark, d):
    return rounded_top(linear(rel(spark, d, "scored").where("system in ('alder', 'dune')"), both=True), 10)


#: Weights of the modalities, and the score from which a modality counts as evidence (fixed values).
WEIGHTS = {"text": 0.4, "chemical": 0.3, "sequence": 0.3}
SIGNIFICANT = {"text": 0.1, "chemical": 0.3, "sequence": 0.3}
LEAST_COMBINED = 0.1

_MODAL = """WITH jt AS (SELECT split_part(query_id, '-', 1) AS query_id, doc_id, max(s) / 3 AS score FROM (SELECT provider, clean_id(statement_id) AS query_id, clean_id(doc_id) AS doc_id, avg(relevance_score) AS s FROM relevance_judgments WHERE relevance_score BETWEEN 0 AND 3 AND statement_id IS NOT NULL AND doc_id IS NOT NULL AND provider IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
ct AS (SELECT query_id, source_id AS doc_id, max(similarity) AS score FROM chemical_hits WHERE similarity BETWEEN 0 AND 1 AND NOT isnan(similarity) AND query_id IS NOT NULL AND source_id IS NOT NULL GROUP BY 1, 2),
st AS (SELECT split_part(query_id, '-', 1) AS query_id, subject_id AS doc_id, max(identity) / 100 AS score FROM blast_hits WHERE identity BETWEEN 0 AND 100 AND query_id IS NOT NULL AND subject_id IS NOT NULL GROUP BY 1, 2),
t AS (SELECT *, 'text' AS modality FROM jt UNION ALL SELECT *, 'chemical' FROM ct UNION ALL SELECT *, 'sequence' FROM st),
p AS (SELECT query_id, doc_id, jt.score AS x, ct.score AS c, st.score AS s FROM jt FULL JOIN ct USING (query_id, doc_id) FULL JOIN st USING (query_id, doc_id))
"""


def modal_hits(spark, d) -> DataFrame:
    """(query_id, doc_id, modality, score): the best text, chemical and sequence hit per patent and document."""
    from ..sources.tables import table

    x = rel(spark, d, "scored").groupBy(F.split_part("query_id", F.lit("-"), F.lit(1)).alias("query_id"), "doc_id").agg((F.max("score") / 3).alias("score")).withColumn("modality", F.lit("text"))
    c = table(spark, d, "chemical_hits").where("similarity between 0 and 1 and not isnan(similarity) and query_id is not null and source_id is not null")
    c = c.groupBy("query_id", F.col("source_id").alias("doc_id")).agg(F.max("similarity").alias("score")).withColumn("modality", F.lit("chemical"))
    b = table(spark, d, "blast_hits").where("identity between 0 and 100 and query_id is not null and subject_id is not null")
    b = b.groupBy(F.split_part("query_id", F.lit("-"), F.lit(1)).alias("query_id"), F.col("subject_id").alias("doc_id")).agg((F.max("identity") / 100).alias("score")).withColumn("modality", F.lit("sequence"))
    return x.unionByName(c).unionByName(b)


def pivoted(hits: DataFrame) -> DataFrame:
    """A row per document in any modality; its scores, null where it has none. One aggregation instead of outer joins."""
    return hits.groupBy("query_id", "doc_id").agg(*(F.max(F.when(F.col("modality") == m, F.col("score"))).alias(m) for m in WEIGHTS))


def match_type() -> Column:
    """Which modalities give evidence; text alone where none does."""
    has = {m: F.coalesce(F.col(m) >= least, F.lit(False)) for m, least in SIGNIFICANT.items()}
    named = F.concat_ws("_", *(F.when(has[m], F.lit(m)) for m in WEIGHTS))
    return F.when(has["text"] & has["chemical"] & has["sequence"], "all").when(named == "", "text").otherwise(named)


def trimodal(spark, d, weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, doc_id, score, match_type): weighted sums over the modalities at hand, their weights
    brought to one, from ``LEAST_COMBINED`` on."""
    w = weights or WEIGHTS
    total = sum(w.values())
    score = sum(F.coalesce(F.col(m), F.lit(0.0)) * (x / total) for m, x in w.items())
    return pivoted(modal_hits(spark, d)).select("query_id", "doc_id", score.alias("score"), match_type().alias("match_type")).where(F.round("score", 9) >= LEAST_COMBINED)


_TYPE = "CASE WHEN coalesce(x, 0) >= 0.1 THEN CASE WHEN coalesce(c, 0) >= 0.3 AND coalesce(s, 0) >= 0.3 THEN 'all' WHEN coalesce(c, 0) >= 0.3 THEN 'text_chemical' WHEN coalesce(s, 0) >= 0.3 THEN 'text_sequence' ELSE 'text' END WHEN coalesce(c, 0) >= 0.3 THEN CASE WHEN coalesce(s, 0) >= 0.3 THEN 'chemical_sequence' ELSE 'chemical' END WHEN coalesce(s, 0) >= 0.3 THEN 'sequence' ELSE 'text' END"


@CAT.query("fus_trimodal_w", _MODAL + f", f AS (SELECT query_id, doc_id, 0.4::DOUBLE * coalesce(x, 0) + 0.3::DOUBLE * coalesce(c, 0) + 0.3::DOUBLE * coalesce(s, 0) AS score, {_TYPE} AS match_type FROM p) SELECT query_id, doc_id, round(score, 6) AS score, match_type FROM f WHERE round(score, 9) >= 0.1")
def _trimodal(spark, d):
    return trimodal(spark, d).withColumn("score", F.round("score", 6))


@CAT.query("fus_trimodal_rrf", _MODAL + ", r AS (SELECT *, row_number() OVER (PARTITION BY modality, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM t), f AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM r GROUP BY 1, 2)" + _TOP.format(k=5))
def _trimodal_rrf(spark, d):
    return rounded_top(reciprocal_rank(modal_hits(spark, d).withColumnRenamed("modality", "system")), 5)


@CAT.query("fus_trimodal_boost", _MODAL + ", f AS (SELECT query_id, doc_id, (0.4::DOUBLE * coalesce(x, 0) + 0.3::DOUBLE * coalesce(c, 0) + 0.3::DOUBLE * coalesce(s, 0)) / (CASE WHEN x IS NULL THEN 0 ELSE 0.4::DOUBLE END + CASE WHEN c IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN s IS NULL THEN 0 ELSE 0.3::DOUBLE END) * (1 + 0.1::DOUBLE * ((x IS NOT NULL)::INT + (c IS NOT NULL)::INT + (s IS NOT NULL)::INT - 1)) AS score FROM p)" + _TOP.format(k=5))
def _boost(spark, d):
    """Weights of the matched modalities alone in the denominator, and a tenth more for each further one."""
    p = pivoted(modal_hits(spark, d))
    score = sum(F.coalesce(F.col(m), F.lit(0.0)) * x for m, x in WEIGHTS.items())
    active = sum(F.when(F.col(m).isNull(), 0.0).otherwise(x) for m, x in WEIGHTS.items())
    n = sum(F.col(m).isNotNull().cast("int") for m in WEIGHTS)
    return rounded_top(p.select("query_id", "doc_id", (score / active * (1 + 0.1 * (n - 1))).alias("score")), 5)


@CAT.query("join_full_outer_modal", _MODAL + "SELECT query_id, count(*) AS n_docs, count(x) AS n_text, count(c) AS n_chemical, count(s) AS n_sequence, count(*) FILTER (WHERE (x IS NULL)::INT + (c IS NULL)::INT + (s IS NULL)::INT < 2) AS n_several FROM p GROUP BY 1")
def _outer(spark, d):
    """Documents in any modality per query, and how many come from each and from several."""
    n = sum(F.col(m).isNotNull().cast("int") for m in WEIGHTS)
    return pivoted(modal_hits(spark, d)).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_docs"), *(F.count(m).alias(f"n_{m}") for m in WEIGHTS), F.count_if(n > 1).alias("n_several"))
