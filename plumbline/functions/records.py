"""Scalar rules over codes, labels, JSON answers and nested claims."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.catalog import Catalogue, rel, withs
from ..sources.tables import table

CAT = Catalogue()
queries, oracle_sql = CAT.queries, CAT.oracle_sql


def first_class(codes: Column) -> Column:
    """First four characters of the first code; empty for none."""
    return F.coalesce(F.substring(F.get(codes, F.lit(0)), 1, 4), F.lit(""))


def classes(codes: Column) -> Column:
    """Distinct classes: four characters if the fourth is a letter, else three; shorter codes are left out."""
    ok = F.filter(F.coalesce(codes, F.array().cast("array<string>")), lambda c: F.length(c) >= 3)
    return F.array_sort(F.array_distinct(F.transform(ok, lambda c: F.when(c.rlike("^.{3}[A-Za-z]"), F.substring(c, 1, 4)).otherwise(F.substring(c, 1, 3)))))


#: Concepts and their classes (fixed values); the given tables' ids of up to three digits stand for the
#: entry of their number's remainder.
CONCEPT_CLASSES = (
    ("C71924100", ("A61",)),
    ("C126322002", ("A61B", "A61F")),
    ("C203014093", ("A61K",)),
    ("C502942594", ("A61P",)),
    ("C185592680", ("C07",)),
    ("C178790620", ("C07D",)),
    ("C55493867", ("C07K",)),
    ("C86803240", ("C12",)),
    ("C54355233", ("C12N",)),
    ("C104317684", ("C12Q",)),
    ("C76155785", ("G01N",)),
)


def concept_classes(concepts: Column) -> Column:
    """Classes of a list of concepts, by the tail of their ids; unknown concepts have none."""
    known = F.array(*(F.lit(k) for k, _ in CONCEPT_CLASSES))
    listed = F.array(*(F.array(*(F.lit(c) for c in cs)) for _, cs in CONCEPT_CLASSES))

    def of(x: Column) -> Column:
        tail = F.substring_index(x["id"], "/", -1)
        short = F.nullif(F.regexp_extract(tail, "^C([0-9]{1,3})$", 1), F.lit("")).try_cast("int") % len(CONCEPT_CLASSES)
        return F.get(listed, F.coalesce(F.nullif(F.array_position(known, tail).cast("int"), F.lit(0)) - 1, short))

    return F.array_sort(F.array_distinct(F.flatten(F.filter(F.transform(F.coalesce(concepts, F.array()), of), lambda a: a.isNotNull()))))


def label(c: Column) -> Column:
    """PARTIAL before ANTICIPATED before NOVEL, by what the answer contains; NOVEL by default."""
    u = F.upper(F.coalesce(c, F.lit("")))
    return F.when(u.contains("PARTIAL"), "PARTIALLY_ANTICIPATED").when(u.contains("ANTICIPAT") & ~u.contains("NOT ANTICIPAT"), "ANTICIPATED").otherwise("NOVEL")


def kappa_label(k: Column) -> Column:
    """Six bands of agreement (fixed values)."""
    return F.when(k < 0, "poor").when(k <= 0.2, "slight").when(k <= 0.4, "fair").when(k <= 0.6, "moderate").when(k <= 0.8, "substantial").otherwise("almost perfect")


def threat(coverage: Column) -> Column:
    return F.when(coverage >= 0.9, "critical").when(coverage >= 0.7, "high").when(coverage >= 0.4, "medium").when(coverage > 0, "low").otherwise("none")


def answer_json(c: Column) -> Column:
    """The JSON object of a free answer: without code fences, from the first brace to the last; null if there is none."""
    bare = F.regexp_replace(c, r"(?m)^\s*```\w*\s*$", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))


#: Names of parameters whose values are hidden (fixed values).
SECRET = ("api_key", "apikey", "key", "token", "secret", "password")


def sanitized(params: Column) -> Column:
    """A parameter map with secrets redacted."""
    return F.transform_values(params, lambda k, v: F.when(F.lower(k).isin(*SECRET), F.lit("[REDACTED]")).otherwise(v))


@CAT.query("fn_ipc3", "SELECT query_no, coalesce(substr(ipc_codes[1], 1, 4), '') AS ipc FROM queries")
def _first(spark, d):
    return table(spark, d, "queries").select("query_no", first_class(F.col("ipc_codes")).alias("ipc"))


@CAT.query("fn_ipc3_set", "SELECT query_no, list_sort(list_distinct(list_transform(list_filter(coalesce(ipc_codes, []), lambda c: length(c) >= 3), lambda c: CASE WHEN regexp_matches(c, '^.{3}[A-Za-z]') THEN substr(c, 1, 4) ELSE substr(c, 1, 3) END))) AS classes FROM queries")
def _set(spark, d):
    return table(spark, d, "queries").select("query_no", classes(F.col("ipc_codes")).alias("classes"))


@CAT.query("fn_norm_label", "SELECT judgment_id, CASE WHEN contains(u, 'PARTIAL') THEN 'PARTIALLY_ANTICIPATED' WHEN contains(u, 'ANTICIPAT') AND NOT contains(u, 'NOT ANTICIPAT') THEN 'ANTICIPATED' ELSE 'NOVEL' END AS label FROM (SELECT DISTINCT judgment_id, upper(coalesce(reasoning, '')) AS u FROM relevance_judgments)")
def _label(spark, d):
    return table(spark, d, "relevance_judgments").select("judgment_id", "reasoning").distinct().select("judgment_id", label(F.col("reasoning")).alias("label"))


@CAT.query("fn_kappa_label", "SELECT DISTINCT identity AS x, CASE WHEN identity / 100 - 0.3 < 0 THEN 'poor' WHEN identity / 100 - 0.3 <= 0.2 THEN 'slight' WHEN identity / 100 - 0.3 <= 0.4 THEN 'fair' WHEN identity / 100 - 0.3 <= 0.6 THEN 'moderate' WHEN identity / 100 - 0.3 <= 0.8 THEN 'substantial' ELSE 'almost perfect' END AS band FROM blast_hits WHERE identity IS NOT NULL")
def _kappa(spark, d):
    return table(spark, d, "blast_hits").where("identity is not null").select(F.col("identity").alias("x")).distinct().withColumn("band", kappa_label(F.col("x") / 100 - 0.3))


@CAT.query("fn_threat_level", "SELECT CASE WHEN query_coverage / 100 >= 0.9 THEN 'critical' WHEN query_coverage / 100 >= 0.7 THEN 'high' WHEN query_coverage / 100 >= 0.4 THEN 'medium' WHEN query_coverage > 0 THEN 'low' ELSE 'none' END AS threat, count(*) AS n FROM blast_hits WHERE query_coverage IS NOT NULL AND NOT isnan(query_coverage) GROUP BY 1")
def _threat(spark, d):
    return table(spark, d, "blast_hits").where("query_coverage is not null and not isnan(query_coverage)").groupBy(threat(F.col("query_coverage") / 100).alias("threat")).agg(F.count(F.lit(1)).alias("n"))


@CAT.query("fn_llm_json", "SELECT event_id, json_extract_string(p, '$.page') AS page, p IS NOT NULL AS found FROM (SELECT event_id, TRY_CAST(props AS JSON) AS p FROM events)")
def _json(spark, d):
    wrapped = F.concat(F.lit("Here is the answer:\n```json\n"), "props", F.lit("\n```\n"))
    e = table(spark, d, "events").select("event_id", answer_json(wrapped).alias("p"))
    return e.select("event_id", F.get_json_object("p", "$.page").alias("page"), F.col("p").isNotNull().alias("found"))


@CAT.query("fn_sanitize", "SELECT event_id, CASE WHEN event_type IS NOT NULL THEN '[REDACTED]' END AS token, CASE WHEN event_type IS NOT NULL THEN '[REDACTED]' END AS apikey, CAST(user_id AS STRING) AS user_id FROM events")
def _sanitize(spark, d):
    m = F.create_map(F.lit("Token"), F.col("event_type"), F.lit("APIkey"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    e = table(spark, d, "events").select("event_id", sanitized(m).alias("m"), "event_type")
    return e.select("event_id", F.when(F.col("event_type").isNotNull(), F.col("m")["Token"]).alias("token"), F.when(F.col("event_type").isNotNull(), F.col("m")["APIkey"]).alias("apikey"), F.col("m")["user"].alias("user_id"))


_MAP_ROWS = ", ".join(f"({i}, '{k}', '{c}')" for i, (k, cs) in enumerate(CONCEPT_CLASSES) for c in cs)


@CAT.query("fn_concept_ipc", f"WITH m(i, id, cls) AS (VALUES {_MAP_ROWS}), c AS (SELECT DISTINCT paper_id, regexp_extract(x.id, '[^/]*$') AS id FROM (SELECT paper_id, unnest(concepts) AS x FROM papers)) SELECT paper_id, string_agg(DISTINCT cls, ' ' ORDER BY cls) AS classes FROM c JOIN m ON m.id = c.id OR m.i = try_cast(nullif(regexp_extract(c.id, '^C([0-9]{{1,3}})$', 1), '') AS INT) % {len(CONCEPT_CLASSES)} GROUP BY 1")
def _concept(spark, d):
    p = table(spark, d, "papers").select("paper_id", concept_classes(F.col("concepts")).alias("c")).distinct()
    return p.where("size(c) > 0").select("paper_id", F.array_join("c", " ").alias("classes"))


def domain_type(query_classes: Column, doc_classes: Column) -> Column:
    """IN where the two sides share a class; nothing on either side is OUT."""
    none = F.array().cast("array<string>")
    return F.when(F.arrays_overlap(F.coalesce(query_classes, none), F.coalesce(doc_classes, none)), "IN").otherwise("OUT")


@CAT.query("fn_domain_type", withs("qrels") + f""", m(i, id, cls) AS (VALUES {_MAP_ROWS}), w AS (SELECT doc_id, m.cls FROM (SELECT DISTINCT doc_id FROM qrels) JOIN m ON m.i = try_cast(right(doc_id, 1) AS INT)),
q AS (SELECT clean_id(_id) AS query_id, unnest(ipc_codes) AS c FROM queries), x AS (SELECT DISTINCT query_id, CASE WHEN regexp_matches(c, '^.{{3}}[A-Za-z]') THEN substr(c, 1, 4) ELSE substr(c, 1, 3) END AS cls FROM q WHERE length(c) >= 3)
SELECT query_id, doc_id, CASE WHEN EXISTS (SELECT 1 FROM x JOIN w USING (cls) WHERE x.query_id = qrels.query_id AND w.doc_id = qrels.doc_id) THEN 'IN' ELSE 'OUT' END AS domain_type FROM qrels""")
def _type(spark, d):
    """The pairs judged; a document's last digit stands for its concept."""
    from .text import clean_id

    q = table(spark, d, "queries").select(clean_id("_id").alias("query_id"), F.explode(classes(F.col("ipc_codes"))).alias("c")).groupBy("query_id").agg(F.collect_set("c").alias("a"))
    concept = F.array(F.struct(F.concat(F.lit("C"), F.right("doc_id", F.lit(1))).alias("id")))
    r = rel(spark, d, "qrels").select("query_id", "doc_id", concept_classes(concept).alias("b"))
    return r.join(q, "query_id", "left").select("query_id", "doc_id", domain_type(F.col("a"), F.col("b")).alias("domain_type"))


@CAT.query("fn_domain_cols_q", "SELECT domain, min(c) AS least_class, count(*) AS n FROM (SELECT coalesce(domain, 'unknown') AS domain, list_min(list_transform(ipc_codes, lambda c: substr(c, 1, 3))) AS c FROM queries) GROUP BY 1")
def _cols(spark, d):
    q = table(spark, d, "queries").select(F.coalesce("domain", F.lit("unknown")).alias("domain"), F.array_min(F.transform("ipc_codes", lambda c: F.substring(c, 1, 3))).alias("c"))
    return q.groupBy("domain").agg(F.min("c").alias("least_class"), F.count(F.lit(1)).alias("n"))


@CAT.query("fn_explode_claims", withs("links") + "SELECT patent_id, unnest(list_sort(list_distinct(list(claim_number)))) AS claim FROM links GROUP BY 1")
def _explode(spark, d):
    l = rel(spark, d, "links").groupBy("patent_id").agg(F.collect_set("claim_number").alias("claims"))
    return l.select("patent_id", F.explode("claims").alias("claim"))


@CAT.query("fn_explode_cited", "SELECT DISTINCT citation_id, unnest(authors) AS author FROM parsed_citations WHERE authors IS NOT NULL")
def _cited(spark, d):
    return table(spark, d, "parsed_citations").select("citation_id", F.explode("authors").alias("author")).distinct()


@CAT.query("fn_tokenize_re", "SELECT item_id, len(regexp_extract_all(lower(text), '[a-z][a-z0-9-]+'))::INT AS n_tokens FROM eval_items")
def _tokens(spark, d):
    return table(spark, d, "eval_items").select("item_id", F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z][a-z0-9-]+"), F.lit(0))).alias("n_tokens"))


@CAT.query("fn_vocab_mismatch", withs("corpus1") + """, w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+')) AS a, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS b FROM corpus1 WHERE title <> '' AND text <> '')
SELECT doc_id, coalesce(len(list_intersect(a, b))::DOUBLE / nullif(len(a), 0) < 0.2 OR len(list_intersect(a, b))::DOUBLE / nullif(len(list_distinct(list_concat(a, b))), 0) < 0.1, false) AS mismatch FROM w""")
def _mismatch(spark, d):
    from .text import words

    w = rel(spark, d, "corpus1").where("title <> '' and text <> ''").select("doc_id", F.array_distinct(words("title")).alias("a"), F.array_distinct(words("text")).alias("b"))
    both = F.size(F.array_intersect("a", "b")).cast("double")
    low = (F.try_divide(both, F.size("a").cast("double")) < 0.2) | (F.try_divide(both, F.size(F.array_union("a", "b")).cast("double")) < 0.1)
    return w.select("doc_id", F.coalesce(low, F.lit(False)).alias("mismatch"))


@CAT.query("fn_independent_claims", r"SELECT query_no, coalesce(nullif(text, ''), _id) AS text FROM queries WHERE text IS NULL OR nullif(regexp_extract(text, '(?i)claim\s+(\d+)', 1), '') IS NULL")
def _independent(spark, d):
    q = table(spark, d, "queries")
    return q.where(F.col("text").isNull() | (F.regexp_extract("text", r"(?i)claim\s+(\d+)", 1) == "")).select("query_no", F.coalesce(F.nullif("text", F.lit("")), "_id").alias("text"))
