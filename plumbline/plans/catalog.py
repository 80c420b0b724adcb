"""The catalogue of queries, and derived relations that several of them read.

``rel`` composes a derived relation as a lazy frame; ``withs`` puts the relation of
the same name, stated apart in plain SQL, in front of a check's SQL, so that each
can show the other's mistakes. In that SQL, ``clean_id(x)`` and ``parse_day(x)``
stand for the clean form of an id and for the date of a string; ``Catalogue.query``
writes them out.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_id
from ..sources.tables import table

# --- relations in Spark --------------------------------------------------------------------


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Citation links come from order lines: the order is the patent, the line the claim, the part the paper."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    patent, number = F.col("l_orderkey").cast("string"), F.col("l_linenumber")
    return lines.select(
        F.concat(patent, F.lit("-c"), number.cast("string")).alias("query_id"),
        patent.alias("patent_id"),
        number.alias("claim_number"),
        F.col("l_partkey").cast("string").alias("paper_id"),
        (1 + F.floor("l_quantity").cast("int") % 10).alias("confidence"),
        F.when(F.col("l_returnflag") == "A", "examiner").when(F.col("l_returnflag") == "R", "applicant").otherwise("both").alias("source"),
        F.col("o_orderdate").cast("date").alias("priority_date"),
        F.when(F.col("l_suppkey") % 13 != 0, F.col("l_shipdate").cast("date")).alias("publication_date"),
    )


def _claims(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    patent, number = F.col("l_orderkey").cast("string"), F.col("l_linenumber")
    return lines.select(F.concat(patent, F.lit("-c"), number.cast("string")).alias("query_id"), patent.alias("patent_id"), number.alias("claim_number"), F.col("o_orderpriority").alias("domain")).distinct()


def _graded(df: DataFrame, grade: str) -> DataFrame:
    """Rows with both ids, in clean form, and a grade from 0 to 3."""
    ids = df.withColumn("query_id", clean_id("statement_id")).withColumn("doc_id", clean_id("doc_id"))
    return ids.where(F.col("query_id").isNotNull() & F.col("doc_id").isNotNull() & F.col(grade).between(0, 3))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    g = _graded(table(spark, d, "relevance_judgments").where("model is not null"), "relevance_score")
    return g.groupBy("query_id", "doc_id", "model").agg(F.max("relevance_score").alias("score"))


def _qrels(spark: SparkSession, d: str) -> DataFrame:
    return _graded(table(spark, d, "consensus_labels"), "consensus_score").groupBy("query_id", "doc_id").agg(F.max("consensus_score").alias("relevance"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    g = _graded(table(spark, d, "relevance_judgments").where("provider is not null"), "relevance_score")
    return g.groupBy(F.col("provider").alias("system"), "query_id", "doc_id").agg(F.avg("relevance_score").alias("score"))


def _doc_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus").where("_id is not null and doc_type is not null").groupBy(clean_id("_id").alias("doc_id")).agg(F.min("doc_type").alias("doc_type"))


def _q_domain(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "queries").where("_id is not null")
    return q.groupBy(clean_id("_id").alias("query_id")).agg(F.min(F.coalesce("domain", F.lit("unknown"))).alias("domain"))


def _q1(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "queries").where("_id is not null and text is not null")
    return q.groupBy(clean_id("_id").alias("query_id")).agg(F.min("text").alias("text"), F.min(F.coalesce("domain", F.lit("unknown"))).alias("domain"))


def _papers1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").groupBy("paper_id").agg(*(F.max(c).alias(c) for c in ("title", "abstract", "journal", "publication_date", "cited_by_count")))


def _corpus1(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "corpus").where("_id is not null")
    return c.groupBy(clean_id("_id").alias("doc_id")).agg(*(F.max(x).alias(x) for x in ("title", "text", "doc_type", "date")))


FRAMES = {"links": _links, "claims": _claims, "judged": _judged, "qrels": _qrels, "scored": _scored, "doc_types": _doc_types, "q_domain": _q_domain, "q1": _q1, "papers1": _papers1, "corpus1": _corpus1}


def rel(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation as a lazy frame over the folder's tables."""
    return FRAMES[name](spark, sf_dir)


# --- the same relations for the checks' SQL ------------------------------------------------

RELATIONS = {
    "links": """SELECT l_orderkey::VARCHAR || '-c' || l_linenumber::VARCHAR AS query_id, l_orderkey::VARCHAR AS patent_id, l_linenumber AS claim_number, l_partkey::VARCHAR AS paper_id,
  (1 + (l_quantity // 1)::INT % 10)::INT AS confidence, CASE l_returnflag WHEN 'A' THEN 'examiner' WHEN 'R' THEN 'applicant' ELSE 'both' END AS source,
  o_orderdate::DATE AS priority_date, CASE WHEN l_suppkey % 13 <> 0 THEN l_shipdate::DATE END AS publication_date FROM orders, lineitem WHERE l_orderkey = o_orderkey""",
    "claims": """SELECT l_orderkey::VARCHAR || '-c' || l_linenumber::VARCHAR AS query_id, l_orderkey::VARCHAR AS patent_id, l_linenumber AS claim_number, any_value(o_orderpriority) AS domain
  FROM orders, lineitem WHERE l_orderkey = o_orderkey GROUP BY l_orderkey, l_linenumber""",
    "judged": """SELECT DISTINCT ON (query_id, doc_id, model) clean_id(statement_id) AS query_id, clean_id(doc_id) AS doc_id, model, relevance_score AS score FROM relevance_judgments
  WHERE relevance_score IN (0, 1, 2, 3) AND length(statement_id || doc_id || model) >= 0 ORDER BY 1, 2, 3, 4 DESC""",
    "qrels": """SELECT DISTINCT ON (query_id, doc_id) clean_id(statement_id) AS query_id, clean_id(doc_id) AS doc_id, consensus_score AS relevance FROM consensus_labels
  WHERE consensus_score IN (0, 1, 2, 3) AND length(statement_id || doc_id) >= 0 ORDER BY 1, 2, 3 DESC""",
    "scored": """SELECT system, query_id, doc_id, sum(v)::DOUBLE / count(*) AS score FROM (SELECT provider AS system, clean_id(statement_id) AS query_id, clean_id(doc_id) AS doc_id, relevance_score AS v FROM relevance_judgments)
  WHERE v IN (0, 1, 2, 3) AND length(system || query_id || doc_id) >= 0 GROUP BY ALL""",
    "doc_types": "SELECT clean_id(_id) AS doc_id, min(doc_type) AS doc_type FROM corpus WHERE length(_id || doc_type) >= 0 GROUP BY 1",
    "q_domain": "SELECT query_id, min(domain) AS domain FROM (SELECT clean_id(_id) AS query_id, ifnull(domain, 'unknown') AS domain FROM queries) WHERE query_id IS NOT NULL GROUP BY 1",
    "q1": "SELECT query_id, min(text) AS text, min(domain) AS domain FROM (SELECT clean_id(_id) AS query_id, text, ifnull(domain, 'unknown') AS domain FROM queries) WHERE length(query_id || text) >= 0 GROUP BY 1",
    "papers1": "SELECT paper_id, max(title) AS title, max(abstract) AS abstract, max(journal) AS journal, max(publication_date) AS publication_date, max(cited_by_count) AS cited_by_count FROM papers GROUP BY 1",
    "corpus1": "SELECT doc_id, max(title) AS title, max(text) AS text, max(doc_type) AS doc_type, max(date) AS date FROM (SELECT clean_id(_id) AS doc_id, * FROM corpus) WHERE doc_id IS NOT NULL GROUP BY 1",
}


def withs(*names: str) -> str:
    """The relations as a WITH clause, to be followed by more of them or a SELECT."""
    return "WITH " + ",\n".join(f"{n} AS ({RELATIONS[n]})" for n in dict.fromkeys(names)) + "\n"


_DAY = (
    "CASE WHEN regexp_matches({x}, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') THEN TRY_CAST(try_strptime({x}, '%Y-%m-%d') AS DATE) WHEN regexp_matches({x}, '^\\d{{4}}/\\d{{1,2}}/\\d{{1,2}}$') THEN TRY_CAST(try_strptime({x}, '%Y/%m/%d') AS DATE)"
    " WHEN regexp_matches({x}, '^\\d{{8}}$') THEN TRY_CAST(try_strptime({x}, '%Y%m%d') AS DATE) WHEN regexp_matches({x}, '^\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}$') THEN TRY_CAST(try_strptime({x}, '%d-%m-%Y') AS DATE)"
    " WHEN regexp_matches({x}, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$') THEN TRY_CAST(try_strptime({x}, '%m/%d/%Y') AS DATE) WHEN regexp_matches({x}, '^\\d{{4}}-\\d{{2}}$') THEN TRY_CAST(try_strptime({x} || '-01', '%Y-%m-%d') AS DATE)"
    " WHEN regexp_matches({x}, '^\\d{{4}}$') THEN TRY_CAST(try_strptime({x} || '-01-01', '%Y-%m-%d') AS DATE) END"
)


def written_out(sql: str) -> str:
    """The check's SQL with ``clean_id`` and ``parse_day`` of a column replaced by what they stand for."""
    sql = re.sub(r"\bclean_id\(([\w.]+)\)", lambda m: f"upper(regexp_replace(regexp_replace({m[1]}, '^[ \\t]+|[ \\t]+$', '', 'g'), '^.*/', ''))", sql)
    return re.sub(r"\bparse_day\(([\w.]+)\)", lambda m: _DAY.format(x=m[1]), sql)


class Catalogue:
    """Queries by name, each with the SQL that must give the same rows."""

    def __init__(self) -> None:
        self.found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def put(f: Callable[[SparkSession, str], DataFrame]):
            self.found[name] = f
            if sql is not None:
                self.sql[name] = written_out(sql)
            return f

        return put

    def queries(self):
        return dict(self.found)

    def oracle_sql(self):
        return dict(self.sql)
