"""Queries of the orphan-reference problem over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import orphans as O


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    refs = O.references(table(spark, sf_dir, "consensus_labels"), "consensus_labels", "label_id", "doc_id", "created_at", "corpus").unionByName(
        O.references(table(spark, sf_dir, "relevance_judgments"), "relevance_judgments", "judgment_id", "statement_id", "judged_at", "queries")
    )
    held = O.parents(table(spark, sf_dir, "corpus"), "corpus", "_id", "ingested_at", "deleted_at").unionByName(O.parents(table(spark, sf_dir, "queries"), "queries", "_id", "added_at", "withdrawn_at"))
    return refs, held


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All references with their flag, from the state advanced year by year."""
    out = None
    for _, more, _, _ in O.batches(*_inputs(spark, sf_dir)):
        out = more.found if out is None else out.unionByName(more.found)
    return O.OrphanState.empty(spark).refs if out is None else out


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References without a live target at the time they were written."""
    return _found(spark, sf_dir).where("orphan").select("ref_table", "row_id").distinct()


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References and orphans per referring table and month of writing."""
    rows = _found(spark, sf_dir).groupBy("ref_table", "row_id", F.date_format("at", "yyyy-MM").alias("month")).agg(F.max(F.col("orphan").cast("bigint")).alias("o"))
    return rows.groupBy("ref_table", "month").agg(F.count(F.lit(1)).alias("n_references"), F.sum("o").alias("n_orphans"))


def p2_waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that wait for a live target at the end of each month in which anything changed."""
    out = None
    refs, held = _inputs(spark, sf_dir)
    for state, more, _, _ in O.batches(refs, held):
        step = O.waiting_counts(state, more, more.now)
        out = step if out is None else out.unionByName(step)
    if out is None:
        return spark.createDataFrame([], "ref_table string, month string, waiting bigint")
    every = out.groupBy("ref_table", "period").agg(F.sum("step").alias("step"))
    return O.running(every).select("ref_table", F.date_format("period", "yyyy-MM").alias("month"), "waiting")


def p2_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References resolved (false) and reopened (true) by each year's arrivals and deletions."""
    out = None
    for _, _, moved, end in O.batches(*_inputs(spark, sf_dir)):
        step = moved.select("ref_table", "row_id", F.year(F.lit(end) - F.expr("interval 1 day")).alias("year"), "waiting")
        out = step if out is None else out.unionByName(step)
    return spark.createDataFrame([], "ref_table string, row_id bigint, year int, waiting boolean") if out is None else out.distinct()


def queries():
    return {"p2_found": p2_found, "p2_counts": p2_counts, "p2_waiting": p2_waiting, "p2_moved": p2_moved}


def _clean(c: str) -> str:
    return f"upper(regexp_replace(regexp_replace({c}, '^[ \\t]+|[ \\t]+$', '', 'g'), '^.*/', ''))"


_REFS = f"""refs AS (
  SELECT DISTINCT 'consensus_labels' AS ref_table, label_id AS row_id, 'corpus' AS target, {_clean('doc_id')} AS key, created_at AS ts
  FROM consensus_labels WHERE doc_id IS NOT NULL AND created_at IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'relevance_judgments', judgment_id, 'queries', {_clean('statement_id')}, judged_at
  FROM relevance_judgments WHERE statement_id IS NOT NULL AND judged_at IS NOT NULL),
held AS (
  SELECT 'corpus' AS target, {_clean('_id')} AS key, ingested_at AS a, coalesce(deleted_at, TIMESTAMP '9999-01-01') AS b FROM corpus WHERE _id IS NOT NULL
  UNION ALL
  SELECT 'queries', {_clean('_id')}, added_at, coalesce(withdrawn_at, TIMESTAMP '9999-01-01') FROM queries WHERE _id IS NOT NULL),
marked AS (
  SELECT r.*, NOT EXISTS (SELECT 1 FROM held h WHERE h.target = r.target AND h.key = r.key AND h.a <= r.ts AND r.ts < h.b) AS orphan FROM refs r)"""


def oracle_sql():
    return {
        "p2_found": f"WITH {_REFS} SELECT DISTINCT ref_table, row_id FROM marked WHERE orphan",
        "p2_counts": f"""WITH {_REFS}, one AS (
  SELECT ref_table, row_id, strftime(ts, '%Y-%m') AS month, max(orphan::int) AS o FROM marked GROUP BY ALL)
SELECT ref_table, month, count(*) AS n_references, sum(o)::BIGINT AS n_orphans FROM one GROUP BY ALL""",
        "p2_waiting": f"""WITH {_REFS},
months AS (
  SELECT DISTINCT ref_table, date_trunc('month', ts) AS m FROM refs
  UNION
  SELECT DISTINCT k.ref_table, date_trunc('month', t.ts) FROM (
    SELECT target, a AS ts FROM held WHERE a < b UNION ALL SELECT target, b FROM held WHERE a < b AND b < TIMESTAMP '9999-01-01') t
  JOIN (SELECT DISTINCT ref_table, target FROM refs) k ON k.target = t.target),
open AS (
  SELECT x.ref_table, x.m, r.row_id FROM months x JOIN refs r ON r.ref_table = x.ref_table AND r.ts < x.m + INTERVAL 1 MONTH
  WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.target = r.target AND h.key = r.key AND h.a < x.m + INTERVAL 1 MONTH AND h.b >= x.m + INTERVAL 1 MONTH))
SELECT x.ref_table, strftime(x.m, '%Y-%m') AS month, count(o.row_id)::BIGINT AS waiting
FROM months x LEFT JOIN open o ON o.ref_table = x.ref_table AND o.m = x.m GROUP BY x.ref_table, x.m""",
        "p2_moved": f"""WITH {_REFS},
years AS (SELECT DISTINCT year(ts) AS y FROM (SELECT ts FROM refs UNION ALL SELECT a FROM held WHERE a < b UNION ALL SELECT b FROM held WHERE a < b AND b < TIMESTAMP '9999-01-01')),
ends AS (SELECT y, make_timestamp(y + 1, 1, 1, 0, 0, 0) AS t, make_timestamp(y, 1, 1, 0, 0, 0) AS t0 FROM years),
seen AS (SELECT DISTINCT r.ref_table, r.row_id, y, NOT EXISTS (SELECT 1 FROM held h WHERE h.target = r.target AND h.key = r.key AND h.a < e.t0 AND h.b >= e.t0) AS was,
  NOT EXISTS (SELECT 1 FROM held h WHERE h.target = r.target AND h.key = r.key AND h.a < e.t AND h.b >= e.t) AS waiting FROM refs r JOIN ends e ON r.ts < e.t0)
SELECT ref_table, row_id, y::INT AS year, waiting FROM seen WHERE was <> waiting""",
    }
