"""Filters, projections, joins and set operations of the benchmark build."""

from __future__ import annotations

from bisect import insort

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.records import CONCEPT_CLASSES, concept_classes
from ..functions.text import clean_id
from ..plans.catalog import Catalogue, rel, withs
from ..plans.shared import materialize
from ..plans.sizing import maybe_broadcast
from ..sources.tables import table

CAT = Catalogue()
queries, oracle_sql = CAT.queries, CAT.oracle_sql


# --- filters and projections -------------------------------------------------------------


def any_prefix(codes: Column, prefixes: list[str]) -> Column:
    """Whether any element starts with one of the prefixes; null and empty arrays don't."""
    return F.coalesce(F.exists(codes, lambda c: F.coalesce(F.greatest(F.lit(False), *(c.startswith(p) for p in prefixes)), F.lit(False))), F.lit(False))


@CAT.query("flt_ipc_prefix", "SELECT query_no FROM queries WHERE len(list_filter(ipc_codes, lambda c: starts_with(c, 'A61') OR starts_with(c, 'C07') OR starts_with(c, 'C12'))) > 0")
def _ipc(spark, d):
    return table(spark, d, "queries").where(any_prefix(F.col("ipc_codes"), ["A61", "C07", "C12"])).select("query_no")


def at_least(df: DataFrame, key: str, n: int, of: str | None = None) -> DataFrame:
    """Rows whose key has at least n rows (or distinct values of a column)."""
    c = F.count(F.lit(1)) if of is None else F.count_distinct(of)
    return df.join(df.groupBy(key).agg(c.alias("_n")).where(F.col("_n") >= n).select(key), key, "left_semi")


@CAT.query("flt_citation_count", withs("links") + "SELECT patent_id, count(*) AS n FROM links GROUP BY 1 HAVING count(*) >= 3")
def _count(spark, d):
    return at_least(rel(spark, d, "links"), "patent_id", 3).groupBy("patent_id").agg(F.count(F.lit(1)).alias("n"))


@CAT.query("flt_validate_papers", "SELECT DISTINCT paper_id FROM papers WHERE paper_id IS NOT NULL AND title IS NOT NULL AND length(title) > 0")
def _valid(spark, d):
    return table(spark, d, "papers").where("paper_id is not null and length(title) > 0").select("paper_id").distinct()


@CAT.query("flt_quality", withs("papers1") + "SELECT paper_id FROM papers1 WHERE length(coalesce(abstract, '')) = 0 OR length(abstract) >= 150")
def _quality(spark, d):
    n = F.length(F.coalesce("abstract", F.lit("")))
    return rel(spark, d, "papers1").where((n == 0) | (n >= 150)).select("paper_id")


@CAT.query("prj_text_stats", withs("papers1") + "SELECT paper_id, length(coalesce(title, ''))::INT AS title_length, length(coalesce(abstract, ''))::INT AS abstract_length, length(coalesce(abstract, '')) > 0 AS has_abstract FROM papers1")
def _stats(spark, d):
    n = F.char_length(F.coalesce("abstract", F.lit("")))
    return rel(spark, d, "papers1").select("paper_id", F.char_length(F.coalesce("title", F.lit(""))).alias("title_length"), n.alias("abstract_length"), (n > 0).alias("has_abstract"))


@CAT.query("flt_predicate", withs("qrels") + "SELECT q.query_no, count(r.doc_id) AS n_judged FROM queries q LEFT JOIN qrels r ON r.query_id = clean_id(q._id) WHERE q.domain = 'oncology' AND len(q.ipc_codes) > 0 GROUP BY 1")
def _predicate(spark, d):
    q = table(spark, d, "queries").where("domain = 'oncology' and size(ipc_codes) > 0").select("query_no", clean_id("_id").alias("query_id"))
    return q.join(rel(spark, d, "qrels"), "query_id", "left").groupBy("query_no").agg(F.count("doc_id").alias("n_judged"))


@CAT.query("flt_ros_patent", withs("links") + "SELECT query_id, paper_id, confidence FROM links WHERE patent_id = '1'")
def _point(spark, d):
    return rel(spark, d, "links").where("patent_id = '1'").select("query_id", "paper_id", "confidence")


@CAT.query("flt_split_domain", withs("links") + "SELECT DISTINCT paper_id FROM links WHERE source IN ('examiner', 'both') AND confidence >= 8")
def _isin(spark, d):
    return rel(spark, d, "links").where("source in ('examiner', 'both') and confidence >= 8").select("paper_id").distinct()


@CAT.query("prj_text_variant_q", withs("papers1") + """SELECT paper_id, v.variant AS variant, v.t AS text FROM papers1, LATERAL (VALUES ('title', coalesce(title, '')), ('abstract', coalesce(abstract, '')), ('title_abstract', concat_ws(' ', title, abstract)), ('journal_title', concat_ws(' ', journal, title))) AS v(variant, t)""")
def _variants(spark, d):
    kinds = {"title": F.coalesce("title", F.lit("")), "abstract": F.coalesce("abstract", F.lit("")), "title_abstract": F.concat_ws(" ", "title", "abstract"), "journal_title": F.concat_ws(" ", "journal", "title")}
    return rel(spark, d, "papers1").select("paper_id", F.inline(F.array(*(F.struct(F.lit(k).alias("variant"), c.alias("text")) for k, c in kinds.items()))))


@CAT.query("prj_text_variant_d", withs("corpus1") + "SELECT doc_id, 'full' AS variant, coalesce(title, '') AS title, coalesce(text, '') AS text FROM corpus1 UNION ALL SELECT doc_id, 'title', coalesce(title, ''), '' FROM corpus1 UNION ALL SELECT doc_id, 'text', '', coalesce(text, '') FROM corpus1")
def _variants_d(spark, d):
    t, x, e = F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")), F.lit("")
    rows = [F.struct(F.lit(k).alias("variant"), a.alias("title"), b.alias("text")) for k, a, b in (("full", t, x), ("title", t, e), ("text", e, x))]
    return rel(spark, d, "corpus1").select("doc_id", F.inline(F.array(*rows)))


@CAT.query("prj_corpus_text", withs("papers1") + "SELECT paper_id, CASE WHEN trim(coalesce(abstract, '')) = '' THEN trim(coalesce(title, '')) ELSE trim(abstract) || chr(10) || chr(10) || '[CLAIM] ' || trim(coalesce(title, '')) END AS corpus_text FROM papers1")
def _corpus_text(spark, d):
    a, c = F.trim(F.coalesce("abstract", F.lit(""))), F.trim(F.coalesce("title", F.lit("")))
    return rel(spark, d, "papers1").select("paper_id", F.when(a == "", c).otherwise(F.concat(a, F.lit("\n\n[CLAIM] "), c)).alias("corpus_text"))


# --- joins ---------------------------------------------------------------------------------


@CAT.query("join_semi_two", withs("links") + "SELECT concat(patent_id, '_', paper_id) AS citation_id, source, confidence FROM links WHERE patent_id IN (SELECT CAST(o_orderkey AS STRING) FROM orders WHERE o_orderstatus = 'F') AND paper_id IN (SELECT CAST(p_partkey AS STRING) FROM part WHERE p_size < 25)")
def _semi_two(spark, d):
    patents = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("patent_id"))
    papers = table(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").cast("string").alias("paper_id"))
    kept = rel(spark, d, "links").join(patents, "patent_id", "left_semi").join(maybe_broadcast(papers), "paper_id", "left_semi")
    return kept.select(F.concat_ws("_", "patent_id", "paper_id").alias("citation_id"), "source", "confidence")


@CAT.query("join_claim_fanout", withs("links", "claims") + "SELECT patent_id, count(*) AS n_rows, count(DISTINCT c.query_id) AS n_claims FROM (SELECT DISTINCT patent_id, paper_id, confidence FROM links WHERE confidence >= 8) l JOIN claims c USING (patent_id) GROUP BY 1")
def _fanout(spark, d):
    l = rel(spark, d, "links").where("confidence >= 8").select("patent_id", "paper_id", "confidence").distinct()
    c = rel(spark, d, "claims").select("patent_id", "query_id")
    return l.join(c, "patent_id").groupBy("patent_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("query_id").alias("n_claims"))


@CAT.query("join_left_lookup", withs("links", "papers1") + "SELECT l.query_id, l.paper_id, p.p_name AS title FROM links l LEFT JOIN (SELECT CAST(p_partkey AS STRING) AS paper_id, p_name FROM part WHERE p_size <= 30) p USING (paper_id)")
def _left(spark, d):
    p = table(spark, d, "part").where("p_size <= 30").select(F.col("p_partkey").cast("string").alias("paper_id"), F.col("p_name").alias("title"))
    return rel(spark, d, "links").select("query_id", "paper_id").join(maybe_broadcast(p), "paper_id", "left").select("query_id", "paper_id", "title")


@CAT.query("join_links_pipeline", withs("links", "claims") + """SELECT c.domain, count(*) AS n_links, count(DISTINCT l.paper_id) AS n_papers FROM links l JOIN claims c USING (query_id)
WHERE l.confidence >= 8 AND l.publication_date < l.priority_date AND l.paper_id IN (SELECT CAST(p_partkey AS STRING) FROM part WHERE p_size < 40) GROUP BY 1""")
def _pipeline(spark, d):
    p = table(spark, d, "part").where("p_size < 40").select(F.col("p_partkey").cast("string").alias("paper_id"))
    l = rel(spark, d, "links").where("confidence >= 8 and publication_date < priority_date").join(maybe_broadcast(p), "paper_id", "left_semi")
    return l.join(rel(spark, d, "claims").select("query_id", "domain"), "query_id").groupBy("domain").agg(F.count(F.lit(1)).alias("n_links"), F.count_distinct("paper_id").alias("n_papers"))


def merged(first: DataFrame, second: DataFrame, keys: list[str], extra: str) -> DataFrame:
    """All rows of the first with a column of the second, and the second's rows that the first lacks."""
    also = second.join(first.select(*keys), keys, "left_anti")
    return first.join(second.select(*keys, extra), keys, "left").unionByName(also, allowMissingColumns=True)


@CAT.query("join_left_anti_union", withs("links") + """, a AS (SELECT patent_id, paper_id, max(confidence) AS confidence FROM links WHERE source = 'examiner' GROUP BY 1, 2), b AS (SELECT patent_id, paper_id, max(claim_number) AS rejection FROM links WHERE source <> 'applicant' GROUP BY 1, 2)
SELECT a.patent_id, a.paper_id, a.confidence, b.rejection FROM a LEFT JOIN b USING (patent_id, paper_id) UNION ALL SELECT b.patent_id, b.paper_id, 10, b.rejection FROM b ANTI JOIN a USING (patent_id, paper_id)""")
def _merge(spark, d):
    l = rel(spark, d, "links")
    a = l.where("source = 'examiner'").groupBy("patent_id", "paper_id").agg(F.max("confidence").alias("confidence"))
    b = l.where("source <> 'applicant'").groupBy("patent_id", "paper_id").agg(F.max("claim_number").alias("rejection"))
    # what the office action alone names counts as sure
    return merged(a, b.withColumn("confidence", F.lit(10)), ["patent_id", "paper_id"], "rejection").select("patent_id", "paper_id", "confidence", "rejection")


@CAT.query("join_left_override", withs("links") + ", r AS (SELECT query_id, max(CASE WHEN claim_number = 1 THEN 3 ELSE 2 END) AS override FROM links WHERE confidence >= 9 GROUP BY 1) SELECT l.query_id, l.paper_id, coalesce(r.override, CASE WHEN l.confidence >= 7 THEN 1 ELSE 0 END)::INT AS relevance FROM links l LEFT JOIN r USING (query_id)")
def _override(spark, d):
    l = rel(spark, d, "links")
    r = l.where("confidence >= 9").groupBy("query_id").agg(F.max(F.when(F.col("claim_number") == 1, 3).otherwise(2)).alias("override"))
    return l.join(r, "query_id", "left").select("query_id", "paper_id", F.coalesce("override", F.when(F.col("confidence") >= 7, 1).otherwise(0)).alias("relevance"))


@CAT.query("join_inner_journal", withs("papers1") + ", pos AS (SELECT paper_id, journal FROM papers1 WHERE cited_by_count >= 20) SELECT paper_id FROM papers1 WHERE journal IN (SELECT journal FROM pos WHERE journal IS NOT NULL) AND paper_id NOT IN (SELECT paper_id FROM pos)")
def _journal(spark, d):
    p = rel(spark, d, "papers1").select("paper_id", "journal", "cited_by_count")
    pos = p.where("cited_by_count >= 20")
    return p.join(pos.select("journal").distinct(), "journal", "left_semi").join(pos.select("paper_id"), "paper_id", "left_anti").select("paper_id")


@CAT.query("join_array_overlap", """WITH c AS (SELECT DISTINCT paper_id, x.id AS concept, x.score AS score FROM (SELECT paper_id, unnest(concepts) AS x FROM papers)), pos AS (SELECT DISTINCT paper_id FROM papers WHERE cited_by_count >= 50)
SELECT DISTINCT paper_id FROM c WHERE score >= 0.5 AND concept IN (SELECT concept FROM c WHERE score >= 0.5 AND paper_id IN (SELECT paper_id FROM pos)) AND paper_id NOT IN (SELECT paper_id FROM pos)""")
def _overlap(spark, d):
    p = table(spark, d, "papers")
    c = p.select("paper_id", F.explode("concepts").alias("x")).where("x.score >= 0.5").select("paper_id", F.col("x.id").alias("concept"))
    pos = p.where("cited_by_count >= 50").select("paper_id").distinct()
    wanted = c.join(pos, "paper_id", "left_semi").select("concept").distinct()
    return c.join(wanted, "concept", "left_semi").select("paper_id").distinct().join(pos, "paper_id", "left_anti")


#: Earlier candidates that a query is given, and salts that the rows of a class are read in.
IPC4_BEST, IPC4_SALTS = 10, 16


def _least_by_day(keys: list[str], k: int):
    """Rows sorted by the keys and by day; yields those that come among the least by (h, other), and the day until which they stay."""

    def run(batches):
        key, held = None, []
        for b in batches:
            out = []
            for row in zip(*(b[c] for c in keys), b["h"], b["other"], b["oid"], b["op"]):
                at, x = row[: len(keys)], row[len(keys) :]
                if at != key:
                    out.extend((*key, *h, None) for h in held)
                    key, held = at, []
                insort(held, x)
                own = [h for h in held if h[2] == x[2]]
                # 2 k rows, k of one oid at most, hold the k least without the rows of any one oid
                gone = own[-1] if len(own) > k else held[-1] if len(held) > 2 * k else None
                if gone is not None:
                    held.remove(gone)
                    if gone[3] < x[3]:  # else no day lies between
                        out.append((*key, *gone, x[3]))
            yield _held(out, keys)
        yield _held([(*key, *h, None) for h in held], keys)

    return run


def _held(rows: list[tuple], keys: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[*keys, "h", "other", "oid", "op", "until"])


def least_by_day(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Rows (ipc4, other, oid, op, h) that for some day are among the k least by (h, other) of their group before that
    day, whatever one oid is left out, with the day ``until`` which they may be (null: for good)."""
    d = rows.withColumn("salt", F.pmod(F.xxhash64("other"), F.lit(IPC4_SALTS)).cast("int")).select("ipc4", "salt", "h", "other", "oid", "op")
    kinds = dict(d.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, "h", "other", "oid", "op"]) + ", until date"
    return d.repartition(*keys).sortWithinPartitions(*keys, "op").mapInPandas(_least_by_day(keys, k), schema)


@CAT.query("join_ipc4_nonequi", """WITH q AS (SELECT clean_id(_id) AS id, query_no, parse_day(priority_date) AS p, ipc_codes AS codes FROM queries), f AS (SELECT id, query_no, p, substr(codes[1], 1, 4) AS ipc4 FROM q WHERE len(codes) > 0),
e AS (SELECT DISTINCT query_no, id, p, substr(unnest(codes), 1, 4) AS ipc4 FROM q),
m AS (SELECT f.query_no, e.query_no AS other, row_number() OVER (PARTITION BY f.query_no ORDER BY md5('42:' || e.query_no), e.query_no) AS r FROM f JOIN e ON e.ipc4 = f.ipc4 AND e.id <> f.id AND e.p < f.p)
SELECT query_no, other FROM m WHERE r <= 10""")
def _ipc4(spark, d):
    q = table(spark, d, "queries").select(clean_id("_id").alias("id"), "query_no", parse_date(F.col("priority_date")).alias("p"), "ipc_codes").where("p is not null")
    f = q.where("size(ipc_codes) > 0").select("id", "query_no", "p", F.substring(F.get("ipc_codes", F.lit(0)), 1, 4).alias("ipc4"))
    e = q.select(F.col("id").alias("oid"), F.col("query_no").alias("other"), F.col("p").alias("op"), F.explode("ipc_codes").alias("code")).select("oid", "other", "op", F.substring("code", 1, 4).alias("ipc4")).distinct()
    from .ranking import hash_order, ranked

    f = f.where("id is not null").withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("query_no")))
    e = e.where("oid is not null").withColumn("h", F.md5(F.concat(F.lit("42:"), F.col("other").cast("string"))))
    # each salt of a class by itself, then what they leave: so no class is one task
    held = least_by_day(least_by_day(e, ["ipc4", "salt"], IPC4_BEST), ["ipc4"], IPC4_BEST)
    held = materialize(held.groupBy("ipc4").agg(F.array_sort(F.collect_list(F.struct("h", "other", "oid", "op", "until"))).alias("held")), "ipc4-held")
    good = F.filter("held", lambda x: (x["oid"] != F.col("id")) & (x["op"] < F.col("p")) & F.coalesce(F.col("p") <= x["until"], F.lit(True)))
    m = f.join(maybe_broadcast(held), "ipc4").select("query_no", "same", F.explode(F.transform(F.slice(good, 1, IPC4_BEST), lambda x: x["other"])).alias("other"))
    several = ranked(m.where("same > 1"), ["query_no"], hash_order("other", 42), IPC4_BEST)
    return m.where("same = 1").select("query_no", "other").unionByName(several.select("query_no", "other"))


_CLASS_ROWS = ", ".join(f"({i}, '{k}', '{c}')" for i, (k, cs) in enumerate(CONCEPT_CLASSES) for c in cs)


@CAT.query("join_domain_overlap", withs("qrels") + f""", m(i, id, cls) AS (VALUES {_CLASS_ROWS}),
q AS (SELECT DISTINCT query_id, CASE WHEN regexp_matches(c, '^.{{3}}[A-Za-z]') THEN substr(c, 1, 4) ELSE substr(c, 1, 3) END AS cls FROM (SELECT clean_id(_id) AS query_id, unnest(ipc_codes) AS c FROM queries) WHERE length(c) >= 3),
p AS (SELECT DISTINCT doc_id, cls FROM (SELECT paper_id AS doc_id, regexp_extract(x.id, '[^/]*$') AS id FROM (SELECT paper_id, unnest(concepts) AS x FROM papers)) c JOIN m ON m.id = c.id OR m.i = try_cast(nullif(regexp_extract(c.id, '^C([0-9]{{1,3}})$', 1), '') AS INT) % {len(CONCEPT_CLASSES)}),
b AS (SELECT DISTINCT query_id, doc_id FROM qrels JOIN q USING (query_id) JOIN p USING (doc_id) WHERE q.cls = p.cls)
SELECT query_id, doc_id, relevance, CASE WHEN b.doc_id IS NULL THEN 'OUT' ELSE 'IN' END AS domain_type FROM qrels LEFT JOIN b USING (query_id, doc_id)""")
def _qrels_domain(spark, d):
    """Every judged pair, IN where query and paper share a class; a missing side is OUT."""
    c = F.col("c")
    q = table(spark, d, "queries").select(clean_id("_id").alias("query_id"), F.explode("ipc_codes").alias("c")).where("length(c) >= 3")
    q = q.groupBy("query_id").agg(F.collect_set(F.when(c.rlike("^.{3}[A-Za-z]"), F.substring(c, 1, 4)).otherwise(F.substring(c, 1, 3))).alias("a"))
    p = table(spark, d, "papers").select(F.col("paper_id").alias("doc_id"), F.explode(concept_classes(F.col("concepts"))).alias("c")).groupBy("doc_id").agg(F.collect_set("c").alias("b"))
    shared = F.coalesce(F.arrays_overlap("a", "b"), F.lit(False))
    return rel(spark, d, "qrels").join(q, "query_id", "left").join(p, "doc_id", "left").select("query_id", "doc_id", "relevance", F.when(shared, "IN").otherwise("OUT").alias("domain_type"))


@CAT.query("join_corpus_to_queries", withs("corpus1", "qrels") + "SELECT doc_id, doc_type FROM corpus1 WHERE doc_id IN (SELECT doc_id FROM qrels WHERE query_id IN (SELECT clean_id(_id) FROM queries WHERE split = 'test'))")
def _to_queries(spark, d):
    q = table(spark, d, "queries").where("split = 'test'").select(clean_id("_id").alias("query_id"))
    docs = rel(spark, d, "qrels").join(q, "query_id", "left_semi").select("doc_id")
    return rel(spark, d, "corpus1").select("doc_id", "doc_type").join(docs, "doc_id", "left_semi")


@CAT.query("join_negatives_anti", withs("corpus1", "qrels") + ", n AS (SELECT doc_id FROM corpus1 WHERE doc_id NOT IN (SELECT doc_id FROM qrels WHERE relevance > 0)) SELECT doc_id FROM n ORDER BY md5('7:' || doc_id), doc_id LIMIT 100")
def _negatives(spark, d):
    from .ranking import hash_order

    pos = rel(spark, d, "qrels").where("relevance > 0").select("doc_id")
    return rel(spark, d, "corpus1").select("doc_id").join(pos, "doc_id", "left_anti").orderBy(*hash_order("doc_id", 7)).limit(100)


@CAT.query("join_split_qrels", withs("qrels") + ", s AS (SELECT clean_id(_id) AS query_id, min(split) AS split FROM queries WHERE split IS NOT NULL GROUP BY 1) SELECT split, count(*) AS n, count(DISTINCT query_id) AS n_queries FROM qrels JOIN s USING (query_id) GROUP BY 1")
def _split_qrels(spark, d):
    s = table(spark, d, "queries").where("split is not null").groupBy(clean_id("_id").alias("query_id")).agg(F.min("split").alias("split"))
    return rel(spark, d, "qrels").join(s, "query_id").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("query_id").alias("n_queries"))


@CAT.query("join_step4_corpus", withs("links") + "SELECT DISTINCT paper_id FROM links WHERE patent_id IN (SELECT CAST(o_orderkey AS STRING) FROM orders WHERE o_orderpriority = '1-URGENT')")
def _step4(spark, d):
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").cast("string").alias("patent_id"))
    return rel(spark, d, "links").join(o, "patent_id", "left_semi").select("paper_id").distinct()


def day_by_fallback(claims: DataFrame, patents: DataFrame, dates: DataFrame) -> DataFrame:
    """(query_id, patent_id, day) of claims (query_id, patent_id), with the first source that has any
    date at all: patents (patent_id, day), else dates (patent_id, day), else a constant."""
    known = patents.where("day is not null").groupBy("patent_id").agg(F.min("day").alias("a"))
    other = dates.where("day is not null").groupBy("patent_id").agg(F.min("day").alias("b"))
    some = known.agg((F.count("a") > 0).alias("sa")).crossJoin(other.agg((F.count("b") > 0).alias("sb")))  # one row by construction
    j = claims.join(known, "patent_id", "left").join(other, "patent_id", "left").crossJoin(F.broadcast(some))
    return j.select("query_id", "patent_id", F.when(F.col("sa"), F.col("a")).when(F.col("sb"), F.col("b")).otherwise(F.lit("2000-01-01").cast("date")).alias("day"))


@CAT.query("join_date_fallback", withs("claims") + """, q AS (SELECT clean_id(_id) AS id, parse_day(priority_date) AS p FROM queries WHERE clean_id(_id) LIKE 'US%-C%'),
c AS (SELECT DISTINCT id AS query_id, split_part(id, '-', 1) AS patent_id FROM q), a AS (SELECT split_part(id, '-', 1) AS patent_id, min(p) AS day FROM q GROUP BY 1)
SELECT query_id, strftime(CASE WHEN (SELECT count(day) FROM a) > 0 THEN day ELSE DATE '2000-01-01' END, '%Y-%m-%d') AS day FROM c LEFT JOIN a USING (patent_id)""")
def _fallback(spark, d):
    """Claims of the queries with their patent's earliest priority date; corpus dates, then a constant, stand in where no patent has one."""
    q = table(spark, d, "queries").select(clean_id("_id").alias("query_id"), parse_date(F.col("priority_date")).alias("day")).where("query_id like 'US%-C%'").withColumn("patent_id", F.split_part("query_id", F.lit("-"), F.lit(1)))
    dates = table(spark, d, "corpus").select(clean_id("_id").alias("patent_id"), parse_date(F.col("date")).alias("day"))
    return day_by_fallback(q.select("query_id", "patent_id").distinct(), q, dates).select("query_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


def claim_papers(rejections: DataFrame, cited: DataFrame, patents: DataFrame) -> DataFrame:
    """(query_id, paper_id) once each: rejected claims (app_id, letter, claim_number) with the papers cited in
    the same letter (app_id, letter, paper_id) of an application that became a patent (app_id, patent_id)."""
    j = rejections.join(cited.where("paper_id is not null"), ["app_id", "letter"]).join(patents.select("app_id", "patent_id").distinct(), "app_id", "left")
    return j.select(F.concat("patent_id", F.lit("-c"), F.col("claim_number").cast("string")).alias("query_id"), "paper_id").distinct()


@CAT.query("join_claim_paper", "WITH r AS (SELECT DISTINCT l_orderkey AS app_id, l_suppkey AS letter, l_linenumber AS claim_number FROM lineitem WHERE l_returnflag = 'A'), c AS (SELECT l_orderkey AS app_id, l_suppkey AS letter, l_partkey::VARCHAR AS paper_id FROM lineitem), m AS (SELECT DISTINCT o_orderkey AS app_id, 'US' || o_custkey || '-' || o_orderkey AS patent_id FROM orders WHERE o_orderstatus = 'F') SELECT DISTINCT patent_id || '-c' || claim_number AS query_id, paper_id FROM r JOIN c USING (app_id, letter) LEFT JOIN m USING (app_id)")
def _claim_paper(spark, d):
    """Order lines stand for the letters of an application, finished orders for applications that became patents."""
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("app_id"), F.col("l_suppkey").alias("letter"), F.col("l_linenumber").alias("claim_number"), F.col("l_partkey").cast("string").alias("paper_id"), "l_returnflag")
    patents = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("app_id"), F.concat(F.lit("US"), F.col("o_custkey").cast("string"), F.lit("-"), F.col("o_orderkey").cast("string")).alias("patent_id"))
    return claim_papers(l.where("l_returnflag = 'A'").select("app_id", "letter", "claim_number").distinct(), l.select("app_id", "letter", "paper_id"), patents)


# --- sets ----------------------------------------------------------------------------------


def negatives_like(rows: DataFrame, positives: DataFrame, by: str, each: int, seed: int = 42) -> DataFrame:
    """Ids of rows (paper_id, ``by``) that share a value with a positive, up to ``each`` per positive of the value, in hash order."""
    from .ranking import hash_order, ranked

    n = rows.join(positives, "paper_id", "left_semi").where(F.col(by).isNotNull()).groupBy(by).agg((F.count_distinct("paper_id") * each).alias("_k"))
    rest = rows.join(positives, "paper_id", "left_anti").join(n, by)
    return ranked(rest, [by], hash_order("paper_id", seed)).where("rank <= _k").select("paper_id").distinct()


@CAT.query("set_union_corpus", withs("papers1") + """, po AS (SELECT paper_id FROM papers1 WHERE cited_by_count >= 50), c AS (SELECT DISTINCT paper_id, x.id AS concept FROM (SELECT paper_id, unnest(concepts) AS x FROM papers)),
jn AS (SELECT paper_id, row_number() OVER (PARTITION BY journal ORDER BY md5('42:' || paper_id), paper_id) AS r, k FROM papers1 JOIN (SELECT journal, 5 * count(*) AS k FROM papers1 SEMI JOIN po USING (paper_id) WHERE journal IS NOT NULL GROUP BY 1) USING (journal) ANTI JOIN po USING (paper_id)),
cn AS (SELECT paper_id, row_number() OVER (PARTITION BY concept ORDER BY md5('42:' || paper_id), paper_id) AS r, k FROM c JOIN (SELECT concept, 5 * count(*) AS k FROM c SEMI JOIN po USING (paper_id) GROUP BY 1) USING (concept) ANTI JOIN po USING (paper_id)),
u AS (SELECT paper_id, 0 AS o FROM po UNION ALL SELECT paper_id, 1 FROM jn WHERE r <= k UNION ALL SELECT paper_id, 2 FROM cn WHERE r <= k) SELECT paper_id, CASE min(o) WHEN 0 THEN 'positive' WHEN 1 THEN 'journal' ELSE 'concept' END AS kind FROM u GROUP BY 1""")
def _union_corpus(spark, d):
    """Positives and hard negatives, half of the quota of ten each by journal and by concept; an id counts once, with its first kind."""
    p = rel(spark, d, "papers1")
    pos = p.where("cited_by_count >= 50").select("paper_id")
    concepts = table(spark, d, "papers").select("paper_id", F.explode("concepts").alias("x")).select("paper_id", F.col("x.id").alias("concept")).distinct()
    parts = [(pos, 0), (negatives_like(p.select("paper_id", "journal"), pos, "journal", 5), 1), (negatives_like(concepts, pos, "concept", 5), 2)]
    u = parts[0][0].withColumn("o", F.lit(0))
    for df, o in parts[1:]:
        u = u.unionByName(df.withColumn("o", F.lit(o)))
    o = F.min("o")
    return u.groupBy("paper_id").agg(F.when(o == 0, "positive").when(o == 1, "journal").otherwise("concept").alias("kind"))


@CAT.query("set_union_qrels", withs("qrels", "judged") + "SELECT query_id, doc_id, max(relevance) AS relevance FROM (SELECT query_id, doc_id, relevance FROM qrels UNION ALL SELECT query_id, doc_id, score FROM judged) GROUP BY 1, 2 HAVING max(relevance) > 0")
def _union_qrels(spark, d):
    a = rel(spark, d, "qrels").unionByName(rel(spark, d, "judged").select("query_id", "doc_id", F.col("score").alias("relevance")))
    return a.groupBy("query_id", "doc_id").agg(F.max("relevance").alias("relevance")).where("relevance > 0")


@CAT.query("set_union_sources", withs("links") + "SELECT patent_id, paper_id, CASE min(rank) WHEN 1 THEN 'examiner' WHEN 2 THEN 'applicant' ELSE 'negative' END AS source FROM (SELECT patent_id, paper_id, CASE source WHEN 'examiner' THEN 1 WHEN 'applicant' THEN 2 ELSE 3 END AS rank, bool_or(source <> 'both') OVER (PARTITION BY patent_id) AS cited FROM links) WHERE cited GROUP BY 1, 2")
def _union_sources(spark, d):
    """Citations by their first source; negatives (here the links of both sides) only where the patent has a citation of another source."""
    # all branches read one scan: the source is a projection, not a further pass
    l = rel(spark, d, "links")
    cited = l.where("source <> 'both'").select("patent_id").distinct()
    rank = F.min(F.when(F.col("source") == "examiner", 1).when(F.col("source") == "applicant", 2).otherwise(3))
    return l.join(cited, "patent_id", "left_semi").groupBy("patent_id", "paper_id").agg(F.when(rank == 1, "examiner").when(rank == 2, "applicant").otherwise("negative").alias("source"))


@CAT.query("set_common_queries", withs("scored") + "SELECT query_id FROM scored GROUP BY 1 HAVING count(DISTINCT system) = (SELECT count(DISTINCT system) FROM scored)")
def _common(spark, d):
    s = rel(spark, d, "scored").select("query_id", "system").distinct()
    n = s.agg(F.count_distinct("system").alias("n"))  # one row by construction
    return s.groupBy("query_id").agg(F.count(F.lit(1)).alias("k")).crossJoin(F.broadcast(n)).where("k = n").select("query_id")
