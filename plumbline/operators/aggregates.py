"""Aggregations of the benchmark build."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import clean_id
from ..plans.catalog import Catalogue, rel, withs
from ..sources.tables import table

CAT = Catalogue()
queries, oracle_sql = CAT.queries, CAT.oracle_sql


def share(a: Column, b: Column) -> Column:
    """a / b rounded to six digits; 0 where b is 0."""
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 6)


@CAT.query("agg_citations_per_patent", withs("links") + "SELECT patent_id, count(*) AS n FROM links GROUP BY 1")
def _per_patent(spark, d):
    return rel(spark, d, "links").groupBy("patent_id").agg(F.count(F.lit(1)).alias("n"))


@CAT.query("agg_link_stats", withs("links") + ", c AS (SELECT patent_id, count(*) AS n FROM links GROUP BY 1) SELECT (SELECT count(*) FROM links) AS n_links, (SELECT count(DISTINCT paper_id) FROM links) AS n_papers, count(*) AS n_patents, round(avg(n), 6) AS mean, quantile_cont(n::DOUBLE, 0.5) AS median, max(n) AS most FROM c")
def _link_stats(spark, d):
    l = rel(spark, d, "links")
    per = l.groupBy("patent_id").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n_links"), F.count(F.lit(1)).alias("n_patents"), F.round(F.avg("n"), 6).alias("mean"), F.percentile("n", 0.5).alias("median"), F.max("n").alias("most"))
    return per.crossJoin(F.broadcast(l.agg(F.count_distinct("paper_id").alias("n_papers"))))


@CAT.query("agg_qrels_stats", withs("qrels", "doc_types") + ", t AS (SELECT q.*, coalesce(doc_type, 'paper') AS doc_type FROM qrels q LEFT JOIN doc_types USING (doc_id)), c AS (SELECT query_id, count(*) AS n FROM t GROUP BY 1), m AS (SELECT round(avg(n), 6) AS mean_per_query, quantile_cont(n::DOUBLE, 0.5) AS median_per_query FROM c) SELECT doc_type, relevance, count(*) AS n, count(DISTINCT query_id) AS n_queries, count(DISTINCT doc_id) AS n_documents, any_value(mean_per_query) AS mean_per_query, any_value(median_per_query) AS median_per_query FROM t, m GROUP BY 1, 2")
def _qrels_stats(spark, d):
    q = rel(spark, d, "qrels").join(rel(spark, d, "doc_types"), "doc_id", "left")
    per = rel(spark, d, "qrels").groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).agg(F.round(F.avg("n"), 6).alias("mean_per_query"), F.percentile("n", 0.5).alias("median_per_query"))  # one row
    g = q.groupBy(F.coalesce("doc_type", F.lit("paper")).alias("doc_type"), "relevance").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("query_id").alias("n_queries"), F.count_distinct("doc_id").alias("n_documents"))
    return g.crossJoin(F.broadcast(per))


@CAT.query("agg_relevance_dist", withs("qrels") + "SELECT relevance, CASE relevance WHEN 3 THEN 'novelty_destroying' WHEN 2 THEN 'highly_relevant' WHEN 1 THEN 'relevant' ELSE 'not_relevant' END AS label, count(*) AS n FROM qrels GROUP BY 1, 2")
def _dist(spark, d):
    r = F.col("relevance")
    label = F.when(r == 3, "novelty_destroying").when(r == 2, "highly_relevant").when(r == 1, "relevant").otherwise("not_relevant")
    return rel(spark, d, "qrels").groupBy("relevance", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@CAT.query("agg_mapping_stats", withs("links") + "SELECT source, count(DISTINCT query_id) AS n_claims, count(DISTINCT paper_id) AS n_papers, count(*) AS n FROM links GROUP BY 1")
def _mapping(spark, d):
    return rel(spark, d, "links").groupBy("source").agg(F.count_distinct("query_id").alias("n_claims"), F.count_distinct("paper_id").alias("n_papers"), F.count(F.lit(1)).alias("n"))


@CAT.query("agg_concepts", "WITH p AS (SELECT DISTINCT paper_id, concepts FROM papers), c AS (SELECT paper_id, unnest(concepts) AS x FROM p) SELECT x.id AS concept_id, x.name AS concept_name, count(*) AS n, count(DISTINCT paper_id) AS n_papers FROM c WHERE x IS NOT NULL GROUP BY 1, 2")
def _concepts(spark, d):
    p = table(spark, d, "papers").select("paper_id", "concepts").distinct()
    c = p.select("paper_id", F.explode("concepts").alias("x")).where("x is not null")
    return c.groupBy(F.col("x.id").alias("concept_id"), F.col("x.name").alias("concept_name")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("paper_id").alias("n_papers"))


@CAT.query("agg_prior_stats", withs("links") + "SELECT source, count(*) AS n, count(*) FILTER (WHERE source = 'examiner' AND claim_number = 1) AS n_first FROM links GROUP BY 1")
def _prior(spark, d):
    return rel(spark, d, "links").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("source") == "examiner") & (F.col("claim_number") == 1)).alias("n_first"))


@CAT.query("agg_sampling_stats", withs("q1", "qrels") + ", c AS (SELECT domain, q.query_id, count(r.doc_id) AS n FROM q1 q LEFT JOIN qrels r USING (query_id) GROUP BY 1, 2) SELECT domain, count(*) AS n_queries, sum(n)::BIGINT AS n_judged, round(avg(n), 6) AS mean, quantile_cont(n::DOUBLE, 0.5) AS median FROM c GROUP BY 1")
def _sampling(spark, d):
    c = rel(spark, d, "q1").select("query_id", "domain").join(rel(spark, d, "qrels").select("query_id", "doc_id"), "query_id", "left").groupBy("domain", "query_id").agg(F.count("doc_id").alias("n"))
    return c.groupBy("domain").agg(F.count(F.lit(1)).alias("n_queries"), F.sum("n").alias("n_judged"), F.round(F.avg("n"), 6).alias("mean"), F.percentile("n", 0.5).alias("median"))


@CAT.query("agg_split_stats", "SELECT split, domain, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM queries), 6) AS share FROM queries GROUP BY 1, 2")
def _split(spark, d):
    q = table(spark, d, "queries").groupBy("split", "domain").agg(F.count(F.lit(1)).alias("n"))
    return q.crossJoin(F.broadcast(q.agg(F.sum("n").alias("t")))).select("split", "domain", "n", share(F.col("n"), F.col("t")).alias("share"))


@CAT.query("agg_split_validate", "SELECT clean_id(_id) AS query_id, count(DISTINCT split) AS n_splits FROM queries GROUP BY 1 HAVING count(DISTINCT split) > 1")
def _overlap(spark, d):
    return table(spark, d, "queries").groupBy(clean_id("_id").alias("query_id")).agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


@CAT.query("agg_min_citations", r"WITH q AS (SELECT regexp_extract(clean_id(statement_id), '^(.+)-C\d+$', 1) AS patent_id, clean_id(doc_id) AS doc_id FROM relevance_judgments WHERE statement_id IS NOT NULL AND doc_id IS NOT NULL) SELECT patent_id, count(DISTINCT doc_id) AS n FROM q WHERE patent_id <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3")
def _min_citations(spark, d):
    q = table(spark, d, "relevance_judgments").where("statement_id is not null and doc_id is not null").select(F.regexp_extract(clean_id("statement_id"), r"^(.+)-C\d+$", 1).alias("patent_id"), clean_id("doc_id").alias("doc_id"))
    return q.where("patent_id <> ''").groupBy("patent_id").agg(F.count_distinct("doc_id").alias("n")).where("n >= 3")


@CAT.query("agg_domain_stats", withs("qrels", "q_domain") + "SELECT coalesce(domain, 'unknown') AS domain, count(*) AS n, count(DISTINCT q.query_id) AS n_queries FROM qrels q LEFT JOIN q_domain USING (query_id) GROUP BY 1")
def _domains(spark, d):
    q = rel(spark, d, "qrels").join(rel(spark, d, "q_domain"), "query_id", "left")
    return q.groupBy(F.coalesce("domain", F.lit("unknown")).alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("query_id").alias("n_queries"))


@CAT.query("agg_profiles", withs("links", "claims") + """, l AS (SELECT l.paper_id, l.patent_id, l.source, c.domain FROM links l JOIN claims c USING (query_id)), m AS (SELECT paper_id, domain, row_number() OVER (PARTITION BY paper_id ORDER BY count(*) DESC, domain) AS r FROM l GROUP BY 1, 2)
SELECT l.paper_id, count(DISTINCT patent_id) AS n_patents, CASE WHEN bool_or(source = 'both') OR (bool_or(source = 'examiner') AND bool_or(source = 'applicant')) THEN 'both' WHEN bool_or(source = 'examiner') THEN 'examiner' ELSE 'applicant' END AS citation_type, any_value(m.domain) AS domain FROM l JOIN m ON m.paper_id = l.paper_id AND m.r = 1 GROUP BY 1""")
def _profiles(spark, d):
    l = rel(spark, d, "links").select("query_id", "paper_id", "patent_id", "source").join(rel(spark, d, "claims").select("query_id", "domain"), "query_id")
    per = l.groupBy("paper_id", "domain").agg(F.count(F.lit(1)).alias("k"))
    mode = per.groupBy("paper_id").agg(F.min(F.struct((-F.col("k")).alias("k"), "domain")).alias("m")).select("paper_id", F.col("m.domain").alias("domain"))
    kind = F.when(F.bool_or(F.col("source") == "both") | (F.bool_or(F.col("source") == "examiner") & F.bool_or(F.col("source") == "applicant")), "both").when(F.bool_or(F.col("source") == "examiner"), "examiner").otherwise("applicant")
    return l.groupBy("paper_id").agg(F.count_distinct("patent_id").alias("n_patents"), kind.alias("citation_type")).join(mode, "paper_id")


@CAT.query("agg_bench_stats", "SELECT domain, split, source, count(*) AS n FROM queries GROUP BY GROUPING SETS ((domain), (split), (source), ())")
def _bench(spark, d):
    q = table(spark, d, "queries").select("domain", "split", "source")
    return q.groupingSets([["domain"], ["split"], ["source"], []], "domain", "split", "source").agg(F.count(F.lit(1)).alias("n"))


@CAT.query("agg_cost_summary", "SELECT provider, model, count(*) AS n_calls, count(DISTINCT clean_id(statement_id)) AS n_items, sum(cost_usd::DECIMAL(18,6))::DOUBLE AS cost_usd FROM relevance_judgments GROUP BY GROUPING SETS ((provider), (provider, model), ())")
def _calls(spark, d):
    r = table(spark, d, "relevance_judgments").select("provider", "model", "cost_usd", clean_id("statement_id").alias("item"))
    return r.groupingSets([["provider"], ["provider", "model"], []], "provider", "model").agg(F.count(F.lit(1)).alias("n_calls"), F.count_distinct("item").alias("n_items"), F.sum(F.col("cost_usd").cast("decimal(18,6)")).cast("double").alias("cost_usd"))


@CAT.query("agg_invert_qrels", withs("qrels") + "SELECT doc_id AS query_id, concat('patent_', query_id) AS doc_id, greatest(max(relevance), 0) AS relevance FROM qrels GROUP BY 1, 2")
def _invert(spark, d):
    q = rel(spark, d, "qrels").select(F.col("doc_id").alias("query_id"), F.concat(F.lit("patent_"), "query_id").alias("doc_id"), "relevance")
    return q.groupBy("query_id", "doc_id").agg(F.greatest(F.max("relevance"), F.lit(0)).alias("relevance"))


@CAT.query("agg_dual_corpus", withs("papers1", "corpus1") + "SELECT id, kind, max(length(t))::INT AS n_chars FROM (SELECT concat('paper_', paper_id) AS id, 'paper' AS kind, coalesce(abstract, '') AS t FROM papers1 UNION ALL SELECT concat('patent_', doc_id), 'patent', coalesce(text, '') FROM corpus1) GROUP BY 1, 2")
def _dual(spark, d):
    p = rel(spark, d, "papers1").select(F.concat(F.lit("paper_"), "paper_id").alias("id"), F.lit("paper").alias("kind"), F.length(F.coalesce("abstract", F.lit(""))).alias("n"))
    c = rel(spark, d, "corpus1").select(F.concat(F.lit("patent_"), "doc_id").alias("id"), F.lit("patent").alias("kind"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return p.unionByName(c).groupBy("id", "kind").agg(F.max("n").alias("n_chars"))


@CAT.query("agg_type_b_queries", withs("qrels", "corpus1") + ", i AS (SELECT doc_id, count(*) AS n FROM qrels WHERE relevance > 0 GROUP BY 1 HAVING count(*) >= 2) SELECT doc_id, n FROM i JOIN corpus1 USING (doc_id) WHERE length(text) >= 50 ORDER BY md5('42:' || doc_id), doc_id LIMIT 200")
def _type_b(spark, d):
    from .ranking import hash_order

    i = rel(spark, d, "qrels").where("relevance > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    c = rel(spark, d, "corpus1").where("length(text) >= 50").select("doc_id")
    return i.join(c, "doc_id", "left_semi").orderBy(*hash_order("doc_id", 42)).limit(200)


@CAT.query("agg_dataset_statistics", "SELECT lang, count(*) AS n, round(avg(length(text)), 6) AS mean, round(stddev_pop(length(text)), 4) AS deviation, quantile_disc(length(text), 0.5)::INT AS median, quantile_disc(length(text), 0.95)::INT AS p95 FROM documents WHERE text IS NOT NULL GROUP BY 1")
def _dataset(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("lang", F.length("text").alias("n_chars"))
    disc = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY n_chars)").cast("int")
    return t.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.round(F.stddev_pop("n_chars"), 4).alias("deviation"), disc(0.5).alias("median"), disc(0.95).alias("p95"))


@CAT.query("dst_dedupe", "SELECT paper_id, title, cited_by_count FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY loaded_at, title) AS r FROM papers) WHERE r = 1")
def _dedupe(spark, d):
    # the earliest row by a composite key is a minimum of structs: one shuffle, combined before it
    m = table(spark, d, "papers").groupBy("paper_id").agg(F.min(F.struct("loaded_at", F.col("title").isNull().alias("n"), "title", "cited_by_count")).alias("m"))
    return m.select("paper_id", F.col("m.title").alias("title"), F.col("m.cited_by_count").alias("cited_by_count"))


@CAT.query("dst_cited", withs("links") + "SELECT DISTINCT paper_id FROM links")
def _cited(spark, d):
    return rel(spark, d, "links").select("paper_id").distinct()
