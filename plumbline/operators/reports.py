"""Reports that put several operators together, and hooks for models outside the engine."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.text import clean_id, words
from ..plans.catalog import Catalogue, rel, withs
from ..sources.tables import table
from .metrics import _sql, per_query
from .ranking import by_score, positions, ranked
from .stats import pearson

CAT = Catalogue()
queries, oracle_sql = CAT.queries, CAT.oracle_sql


def scored_by(pairs: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series]) -> DataFrame:
    """Hook of a model: adds ``score`` to rows (query_text, doc_text, ...), batch by batch.
    The model is whatever the callable loads; without one a test passes a stub."""
    schema = StructType([*pairs.schema.fields, StructField("score", DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p.assign(score=scorer(p["query_text"], p["doc_text"]).astype(float))

    return pairs.mapInPandas(run, schema)


def token_overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    """Deterministic stub of a relevance model: share of the query's words in the document."""

    def one(x: str, y: str) -> float:
        q, t = (set(re.split(r"[ \t\n\r\f\v]+", (z or "").lower())) - {""} for z in (x, y))
        return len(q & t) / max(1, len(q))

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=float)


@CAT.query("rrk_cross", withs("scored", "q1", "corpus1") + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored WHERE system = 'alder'),
t AS (SELECT r.query_id, r.doc_id, list_distinct(list_filter(regexp_split_to_array(lower(q1.text), '\\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(c.text, '')), '\\s+'), lambda x: x <> '')) AS b FROM r JOIN q1 USING (query_id) JOIN corpus1 c USING (doc_id) WHERE rank <= 20)
SELECT query_id, doc_id, round(len(list_intersect(a, b))::DOUBLE / greatest(1, len(a)), 6) AS score FROM t""")
def _rerank(spark, d):
    """The first window of a run, scored again by a model (here the stub)."""
    top = ranked(rel(spark, d, "scored").where("system = 'alder'"), ["query_id"], by_score(), 20).select("query_id", "doc_id")
    pairs = top.join(rel(spark, d, "q1").select("query_id", F.col("text").alias("query_text")), "query_id").join(rel(spark, d, "corpus1").select("doc_id", F.col("text").alias("doc_text")), "doc_id")
    return scored_by(pairs, token_overlap).select("query_id", "doc_id", F.round("score", 6).alias("score"))


_ANSWERS = withs("scored") + """, w0 AS (SELECT query_id, doc_id, avg(score) AS score FROM scored GROUP BY 1, 2), w1 AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM w0 QUALIFY rank <= 20), w2 AS (SELECT query_id, count(*) AS n FROM w1 GROUP BY 1)"""


def reordered(window: DataFrame, answers: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of a first window (query_id, doc_id, rank) by the order in each answer's JSON
    ``{"ranking": [...]}``: 1 - position / length. Numbers beyond the window are skipped, an answer that
    can't be read leaves the order as it is, documents an answer forgets are out."""
    n = window.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    bare = F.nullif(F.regexp_extract("answer", r"(?s)(\{.*\})", 1), F.lit(""))
    given = F.get_json_object(bare, "$.ranking")
    order = F.coalesce(F.from_json(given, "array<int>"), F.sequence(F.lit(1), F.col("n").cast("int")))
    a = n.join(answers, "query_id", "left").select("query_id", order.alias("o")).select("query_id", F.size("o").alias("m"), F.posexplode("o").alias("pos", "rank"))
    scored = a.groupBy("query_id", "rank").agg(F.max(1 - F.col("pos") / F.col("m")).alias("score"))
    return window.join(scored, ["query_id", "rank"]).select("query_id", "doc_id", "score")


@CAT.query("rrk_llm_list", _ANSWERS + """, a AS (SELECT query_id, n, CASE WHEN right(md5(query_id), 1) < '4' THEN list_transform(range(1, n + 1), lambda i: i) ELSE list_concat([99], list_reverse(range(1, n + 1))) END AS o FROM w2), b AS (SELECT query_id, len(o) AS m, unnest(o) AS rank, unnest(range(len(o))) AS pos FROM a)
SELECT query_id, doc_id, round(1 - pos::DOUBLE / m, 6) AS score FROM w1 JOIN b USING (query_id, rank)""")
def _listwise(spark, d):
    """Answers of a stub: most turn the window round and name a number that isn't there, some can't be read."""
    s = rel(spark, d, "scored").groupBy("query_id", "doc_id").agg(F.avg("score").alias("score"))
    window = ranked(s, ["query_id"], by_score(), 20).select("query_id", "doc_id", "rank")
    n = window.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    text = F.concat(F.lit('```json\n{"ranking": '), F.to_json(F.concat(F.array(F.lit(99)), F.reverse(F.sequence(F.lit(1), F.col("n"))))), F.lit("}\n```"))
    answers = n.select("query_id", F.when(F.right(F.md5("query_id"), F.lit(1)) < "4", "I can't rank these.").otherwise(text).alias("answer"))
    return reordered(window, answers).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@CAT.query("rrk_llm_point", _ANSWERS + """, q2 AS (SELECT clean_id(_id) AS query_id, min(text) AS text FROM queries WHERE text IS NOT NULL AND _id IS NOT NULL GROUP BY 1), c2 AS (SELECT clean_id(_id) AS doc_id, max(text) AS text FROM corpus WHERE _id IS NOT NULL GROUP BY 1),
t AS (SELECT query_id, doc_id, list_distinct(list_filter(regexp_split_to_array(lower(q2.text), '\\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(c2.text, '')), '\\s+'), lambda x: x <> '')) AS b FROM w1 JOIN q2 USING (query_id) JOIN c2 USING (doc_id))
SELECT query_id, doc_id, CASE WHEN len(b) = 0 THEN 0.5::DOUBLE ELSE round(round(10 * len(list_intersect(a, b))::DOUBLE / greatest(1, len(a)), 1) / 10, 6) END AS score FROM t""")
def _pointwise(spark, d):
    """The first twenty scored 0 to 10 by a model's written answer (a stub), brought to one; an answer without a number counts one half."""
    s = rel(spark, d, "scored").groupBy("query_id", "doc_id").agg(F.avg("score").alias("score"))
    top = ranked(s, ["query_id"], by_score(), 20).select("query_id", "doc_id")
    pairs = top.join(rel(spark, d, "q1").select("query_id", F.col("text").alias("query_text")), "query_id").join(rel(spark, d, "corpus1").select("doc_id", F.coalesce("text", F.lit("")).alias("doc_text")), "doc_id")
    answer = F.when(F.trim("doc_text") == "", "no text").otherwise(F.concat(F.lit("Score: "), F.round(10 * F.col("score"), 1).cast("string"), F.lit(" of ten")))
    number = F.nullif(F.regexp_extract(answer, r"(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")
    return scored_by(pairs, token_overlap).select("query_id", "doc_id", F.round(F.when(number.isNull(), 0.5).otherwise(F.least(number, F.lit(10.0)) / 10), 6).alias("score"))


@CAT.query("nov_report", withs("qrels") + "SELECT query_id, CASE WHEN max(relevance) = 3 THEN 'likely_anticipated' WHEN 2 * count(*) FILTER (WHERE relevance >= 2) > count(*) THEN 'likely_obvious' WHEN max(relevance) = 0 THEN 'novel' ELSE 'partially_novel' END AS status, count(*) AS n FROM qrels GROUP BY 1")
def _report(spark, d):
    many = F.count_if(F.col("relevance") >= 2) * 2 > F.count(F.lit(1))
    status = F.when(F.max("relevance") == 3, "likely_anticipated").when(many, "likely_obvious").when(F.max("relevance") == 0, "novel").otherwise("partially_novel")
    return rel(spark, d, "qrels").groupBy("query_id").agg(status.alias("status"), F.count(F.lit(1)).alias("n"))


@CAT.query("snk_expert_csv", withs("qrels") + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS k FROM qrels) SELECT query_id, " + ", ".join(f"max(CASE WHEN k = {k} THEN doc_id END) AS doc_{k}, max(CASE WHEN k = {k} THEN relevance END) AS grade_{k}" for k in range(1, 6)) + " FROM r WHERE k <= 5 GROUP BY 1")
def _sheet(spark, d):
    top = ranked(rel(spark, d, "qrels"), ["query_id"], [F.desc("relevance"), F.asc("doc_id")], 5)
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    return top.groupBy("query_id").agg(*(x for k in range(1, 6) for x in (at(k, "doc_id").alias(f"doc_{k}"), at(k, "relevance").alias(f"grade_{k}"))))


@CAT.query("rep_audit", "SELECT coalesce(provider, '') || ':' || coalesce(model, '') AS endpoint, count(*) AS n_calls, strftime(min(judged_at), '%Y-%m-%d %H:%M:%S') AS first_call, strftime(max(judged_at), '%Y-%m-%d %H:%M:%S') AS last_call FROM relevance_judgments GROUP BY 1")
def _audit(spark, d):
    """Calls by service and endpoint, and their span."""
    end = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    j = table(spark, d, "relevance_judgments")
    return j.groupBy(F.concat(F.coalesce("provider", F.lit("")), F.lit(":"), F.coalesce("model", F.lit(""))).alias("endpoint")).agg(F.count(F.lit(1)).alias("n_calls"), end(F.min("judged_at")).alias("first_call"), end(F.max("judged_at")).alias("last_call"))


def updated(rows: DataFrame, news: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Rows with a column's value taken from ``news`` where that has the key."""
    return rows.join(news.select(*keys, F.col(column).alias("_new")), keys, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def numbered(rows: DataFrame, order: list[str], prefix: str, first: int, width: int = 3) -> DataFrame:
    """Rows with ``code``: the prefix and their number in the order, from ``first``. Counts of ranges of the
    order are summed first, so that no task numbers all rows."""
    one = positions(rows.withColumn("_all", F.lit(0)).withColumn("_key", F.struct(*order)), "_all", "_key", "numbered")
    n = F.col("pos") + first
    text = n.cast("string")
    return one.withColumn("code", F.concat(F.lit(prefix), F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0")))).drop("_all", "_key", "pos")


@CAT.query("scale_merge", withs("qrels") + ", u AS (SELECT clean_id(statement_id) AS query_id, clean_id(doc_id) AS doc_id, max(relevance_score) AS v FROM relevance_judgments WHERE relevance_score BETWEEN 0 AND 3 AND model IS NOT NULL GROUP BY 1, 2) SELECT q.query_id, q.doc_id, coalesce(u.v, q.relevance) AS relevance, 'RN' || CASE WHEN row_number() OVER (ORDER BY q.query_id, q.doc_id) + 100 < 1000 THEN lpad(CAST(row_number() OVER (ORDER BY q.query_id, q.doc_id) + 100 AS VARCHAR), 3, '0') ELSE CAST(row_number() OVER (ORDER BY q.query_id, q.doc_id) + 100 AS VARCHAR) END AS code FROM qrels q LEFT JOIN u USING (query_id, doc_id)")
def _merge(spark, d):
    """Grades of later runs merged by id, and entries numbered on from 101."""
    u = rel(spark, d, "judged").groupBy("query_id", "doc_id").agg(F.max("score").alias("relevance"))
    return numbered(updated(rel(spark, d, "qrels"), u, ["query_id", "doc_id"], "relevance"), ["query_id", "doc_id"], "RN", 101)


@CAT.query("etl_pipeline", withs("links", "claims") + """, k AS (SELECT patent_id FROM links WHERE confidence >= 8 GROUP BY 1 HAVING count(*) >= 2), v AS (SELECT l.query_id, l.paper_id, l.confidence, l.source FROM links l WHERE l.confidence >= 8 AND l.publication_date < l.priority_date AND l.patent_id IN (SELECT patent_id FROM k)),
g AS (SELECT query_id, paper_id, max(CASE WHEN source <> 'applicant' AND confidence >= 9 THEN 2 ELSE 1 END) AS relevance FROM v GROUP BY 1, 2), p AS (SELECT patent_id, min(domain) AS domain FROM claims GROUP BY 1), x AS (SELECT patent_id, count(*) OVER (PARTITION BY domain) AS n, row_number() OVER (PARTITION BY domain ORDER BY md5('42:' || patent_id), patent_id) AS r FROM p),
s AS (SELECT patent_id, CASE WHEN n < 3 OR r <= greatest(1, floor(n * 0.7)) THEN 'train' WHEN r <= greatest(1, floor(n * 0.7)) + greatest(1, floor(n * 0.15)) THEN 'dev' ELSE 'test' END AS split FROM x)
SELECT s.split, g.relevance, count(*) AS n, count(DISTINCT g.query_id) AS n_queries FROM g JOIN s ON s.patent_id = split_part(g.query_id, '-', 1) GROUP BY 1, 2""")
def _etl(spark, d):
    """Links to graded, dated, split judgments: the steps of the build as one lazy plan."""
    from .ranking import split_by_share
    from .relational import at_least

    l = rel(spark, d, "links").where("confidence >= 8")
    v = at_least(l, "patent_id", 2).where("publication_date < priority_date")
    grade = F.max(F.when((F.col("source") != "applicant") & (F.col("confidence") >= 9), 2).otherwise(1))
    g = v.groupBy("patent_id", "query_id", "paper_id").agg(grade.alias("relevance"))
    p = rel(spark, d, "claims").groupBy("patent_id").agg(F.min("domain").alias("domain"))
    s = split_by_share(p, "patent_id", "domain").select("patent_id", "split")
    return g.join(s, "patent_id").groupBy("split", "relevance").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("query_id").alias("n_queries"))
