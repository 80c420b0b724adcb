"""Dates in several spellings, and checks that a document precedes a claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import Catalogue, rel, withs
from ..sources.tables import table

#: Date spellings by the pattern that guards each (fixed values): pattern, Spark format.
FORMATS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{4}-\d{2}$", "yyyy-MM"),
    (r"^\d{4}$", "yyyy"),
]


def parse_date(c: Column) -> Column:
    """Date of a string in one of the spellings; a year is its first of January, a month
    its first day; anything else, and impossible dates, give null."""
    out = None
    for pattern, fmt in FORMATS:
        got = F.try_to_timestamp(c, F.lit(fmt)).cast("date")
        out = F.when(c.rlike(pattern), got) if out is None else out.when(c.rlike(pattern), got)
    return out


def precedes(paper: Column, priority: Column, nulls: str = "invalid") -> Column:
    """Whether the paper is strictly earlier. ``nulls``: a missing date makes the pair
    ``invalid`` (false), is ``drop`` (null, in neither part) or ``keep`` (true)."""
    test = paper < priority
    return test if nulls == "drop" else F.coalesce(test, F.lit(nulls == "keep"))


CAT = Catalogue()
queries, oracle_sql = CAT.queries, CAT.oracle_sql

_D = """CASE WHEN regexp_matches(x, '^\\d{4}-\\d{1,2}-\\d{1,2}$') THEN TRY_CAST(try_strptime(x, '%Y-%m-%d') AS DATE) WHEN regexp_matches(x, '^\\d{4}/\\d{1,2}/\\d{1,2}$') THEN TRY_CAST(try_strptime(x, '%Y/%m/%d') AS DATE)
 WHEN regexp_matches(x, '^\\d{8}$') THEN TRY_CAST(try_strptime(x, '%Y%m%d') AS DATE) WHEN regexp_matches(x, '^\\d{1,2}-\\d{1,2}-\\d{4}$') THEN TRY_CAST(try_strptime(x, '%d-%m-%Y') AS DATE)
 WHEN regexp_matches(x, '^\\d{1,2}/\\d{1,2}/\\d{4}$') THEN TRY_CAST(try_strptime(x, '%m/%d/%Y') AS DATE) WHEN regexp_matches(x, '^\\d{4}-\\d{2}$') THEN TRY_CAST(try_strptime(x || '-01', '%Y-%m-%d') AS DATE)
 WHEN regexp_matches(x, '^\\d{4}$') THEN TRY_CAST(try_strptime(x || '-01-01', '%Y-%m-%d') AS DATE) END"""


@CAT.query("fn_parse_date", f"WITH s AS (SELECT DISTINCT publication_date AS x FROM papers UNION SELECT DISTINCT date FROM corpus) SELECT x AS spelling, strftime({_D}, '%Y-%m-%d') AS day FROM s WHERE x IS NOT NULL")
def _parse(spark, d):
    s = table(spark, d, "papers").select(F.col("publication_date").alias("spelling")).union(table(spark, d, "corpus").select("date")).where("spelling is not null").distinct()
    return s.select("spelling", F.date_format(parse_date(F.col("spelling")), "yyyy-MM-dd").alias("day"))


def _modes(name: str, nulls: str, expr: str):
    @CAT.query(name, withs("links") + f"SELECT valid, count(*) AS n, count(DISTINCT patent_id) AS n_patents FROM (SELECT patent_id, {expr} AS valid FROM links) WHERE valid IS NOT NULL GROUP BY valid")
    def _f(spark, d):
        v = rel(spark, d, "links").select("patent_id", precedes(F.col("publication_date"), F.col("priority_date"), nulls).alias("valid"))
        return v.where("valid is not null").groupBy("valid").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("patent_id").alias("n_patents"))


_modes("flt_temporal", "invalid", "coalesce(publication_date < priority_date, false)")
_modes("flt_temporal_drop", "drop", "publication_date < priority_date")
_modes("flt_temporal_keep", "keep", "coalesce(publication_date < priority_date, true)")


@CAT.query("fn_validate_pair", withs("links") + "SELECT query_id, paper_id, coalesce(publication_date < priority_date, false) AS valid FROM links")
def _pair(spark, d):
    return rel(spark, d, "links").select("query_id", "paper_id", precedes(F.col("publication_date"), F.col("priority_date")).alias("valid"))


@CAT.query("fn_lag_days", withs("links") + "SELECT query_id, paper_id, date_diff('day', priority_date, publication_date)::INT AS lag_days, floor(date_diff('day', priority_date, publication_date) / 365)::BIGINT AS lag_years FROM links WHERE publication_date >= priority_date")
def _lag(spark, d):
    lag = F.date_diff("publication_date", "priority_date")
    return rel(spark, d, "links").where("publication_date >= priority_date").select("query_id", "paper_id", lag.alias("lag_days"), F.floor(lag / 365).alias("lag_years"))


@CAT.query("agg_temporal_violations", withs("links") + """SELECT floor(date_diff('day', priority_date, publication_date) / 365)::BIGINT AS lag_years, count(*) AS n, round(avg(date_diff('day', priority_date, publication_date)), 6) AS mean_lag, max(date_diff('day', priority_date, publication_date))::INT AS max_lag
FROM links WHERE publication_date >= priority_date GROUP BY 1""")
def _violations(spark, d):
    v = rel(spark, d, "links").where("publication_date >= priority_date").select(F.date_diff("publication_date", "priority_date").alias("lag"))
    return v.groupBy(F.floor(F.col("lag") / 365).alias("lag_years")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("lag"), 6).alias("mean_lag"), F.max("lag").alias("max_lag"))


@CAT.query("agg_date_range", withs("links") + "SELECT 'publication' AS which, strftime(min(publication_date), '%Y-%m-%d') AS first_day, strftime(max(publication_date), '%Y-%m-%d') AS last_day, count(publication_date) AS n FROM links UNION ALL SELECT 'priority', strftime(min(priority_date), '%Y-%m-%d'), strftime(max(priority_date), '%Y-%m-%d'), count(priority_date) FROM links")
def _range(spark, d):
    # both columns in one pass: two structs of one aggregation, then two rows
    a = rel(spark, d, "links").agg(*(f(c).alias(f"{c}_{n}") for c in ("publication_date", "priority_date") for n, f in (("lo", F.min), ("hi", F.max), ("n", F.count))))
    row = lambda w: F.struct(F.lit(w).alias("which"), F.date_format(f"{w}_date_lo", "yyyy-MM-dd").alias("first_day"), F.date_format(f"{w}_date_hi", "yyyy-MM-dd").alias("last_day"), F.col(f"{w}_date_n").alias("n"))
    return a.select(F.inline(F.array(row("publication"), row("priority"))))


def before(corpus: DataFrame, day: str, column: str = "date") -> DataFrame:
    """Documents with a date before the day."""
    return corpus.where(parse_date(F.col(column)) < F.lit(day).cast("date"))


@CAT.query("flt_corpus_date", withs("corpus1") + f"SELECT doc_id FROM (SELECT doc_id, date AS x FROM corpus1) WHERE {_D} < DATE '2012-01-01'")
def _corpus_date(spark, d):
    return before(rel(spark, d, "corpus1"), "2012-01-01").select("doc_id")


@CAT.query("flt_date_window", withs("papers1") + "SELECT paper_id FROM papers1 WHERE parse_day(publication_date) < DATE '2020-01-01' AND parse_day(publication_date) >= DATE '2000-01-01'")
def _window(spark, d):
    day = parse_date(F.col("publication_date"))
    return rel(spark, d, "papers1").where((day < F.lit("2020-01-01").cast("date")) & (day >= F.lit("2000-01-01").cast("date"))).select("paper_id")
