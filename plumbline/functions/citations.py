"""Parts of literature citations, claims and rejections as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.catalog import Catalogue
from ..sources.tables import table

#: Patterns of identifiers in citations (fixed values).
PMID = [r"PMID[:\s]*(\d{7,8})", r"PubMed[:\s]*(\d{7,8})", r"pubmed\.ncbi\.nlm\.nih\.gov/(\d{7,8})"]
DOI = [r"DOI[:\s]*(10\.\d{4,}/[^\s,;]+)", r"(?:https?://)?(?:dx\.)?doi\.org/(10\.\d{4,}/[^\s,;]+)", r"(10\.\d{4,}/[^\s,;\"']+)"]
YEAR = r"\b(19\d{2}|20[0-2]\d)\b"
QUOTED = r'"([^"]{20,})"'
AFTER_NAME = r"[A-Z][a-z]+(?:\s+et\s+al\.?)?\.\s+([A-Z][^.]{15,}\.)"
ET_AL = r"^([A-Z][a-z]+(?:\s+[A-Z]\.?)?)\s+et\s+al\.?"
NAMES = r"^([A-Z][a-z]+(?:\s+[A-Z]\.?)?(?:,\s*[A-Z][a-z]+(?:\s+[A-Z]\.?)?)*)"
#: Claim categories that dependent claims name, and the patterns of dependence (fixed values).
_KINDS = "method|composition|compound|device|system|apparatus|kit|article|process|formulation"
DEPENDENT = [
    rf"^\s*(?:The\s+|A\s+)?(?:{_KINDS})\s+(?:of|according\s+to)\s+claim\s+(\d+)",
    rf"^\s*A\s+(?:{_KINDS})\s+as\s+(?:claimed|defined|set\s+forth)\s+in\s+claim\s+(\d+)",
    rf"^\s*The\s+(?:{_KINDS})\s+as\s+claimed\s+in\s+claim\s+(\d+)",
    r"^\s*(?:The\s+)?claim\s+(\d+)",
    r"claim\s+(\d+)\s*,?\s*wherein",
]


def first_of(c: Column, patterns: list[str], flags: str = "(?i)") -> Column:
    """First group of the first pattern that matches, else null."""
    return F.coalesce(*(F.nullif(F.regexp_extract(c, flags + p, 1), F.lit("")) for p in patterns))


def pmid(c: Column) -> Column:
    return first_of(c, PMID)


def doi(c: Column) -> Column:
    """DOI without closing punctuation."""
    return F.regexp_replace(first_of(c, DOI), r"[.,;)\]]+$", "")


def year(c: Column) -> Column:
    return first_of(c, [YEAR], "").cast("int")


def title(c: Column) -> Column:
    """A quoted title of twenty characters or more, else the sentence after the authors."""
    return F.trim(first_of(c, [QUOTED, AFTER_NAME], ""))


def authors(c: Column) -> Column:
    """The name before "et al", else the list of names at the head."""
    lead = first_of(c, [ET_AL], "")
    listed = F.filter(F.transform(F.split(first_of(c, [NAMES], ""), r",\s*(?:and\s+)?"), F.trim), lambda x: x != "")
    return F.when(lead.isNotNull(), F.array(lead)).otherwise(listed)


def method(p: Column, d: Column, t: Column, a: Column) -> Column:
    """By what a citation can be identified."""
    return F.when(p.isNotNull(), "pmid").when(d.isNotNull(), "doi").when(t.isNotNull() | a.isNotNull(), "bibliographic").otherwise("none")


def doi_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"^https?://(?:dx\.)?doi\.org/", ""))


def title_key(c: Column) -> Column:
    """Lower case, letters, digits and single blanks; null up to ten characters."""
    k = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))
    return F.when(F.length(k) > 10, k)


def parent_claim(c: Column) -> Column:
    """Number of the claim that a dependent claim refers to, null for independent ones."""
    return first_of(c, DEPENDENT).try_cast("int")


def ranges(c: Column) -> Column:
    """Sorted distinct numbers of a list such as 1-3,5; parts that are no number are left out."""
    parts = F.split(F.regexp_replace(c, r"\s+", ""), ",")
    lo = lambda x: F.regexp_extract(x, r"^(\d{1,6})(?:-\d{1,6})?$", 1).try_cast("int")
    hi = lambda x: F.regexp_extract(x, r"^(?:\d{1,6}-)?(\d{1,6})$", 1).try_cast("int")
    ok = F.filter(parts, lambda x: x.rlike(r"^\d{1,6}(-\d{1,6})?$") & (lo(x) <= hi(x)))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(ok, lambda x: F.sequence(lo(x), hi(x))))))


def claim_numbers(c: Column) -> Column:
    """Claim numbers named in a text: single ones, lists and ranges."""
    runs = F.regexp_extract_all(c, F.lit(r"(?i)claims?\s+((?:\d+\s*(?:-\s*\d+)?)(?:\s*(?:,|and|,\s*and)\s*\d+\s*(?:-\s*\d+)?)*)"), F.lit(1))
    joined = F.regexp_replace(F.array_join(runs, ","), r"(?i)\s*,?\s*and\s+", ",")
    return F.when(F.size(runs) > 0, ranges(joined)).otherwise(F.array().cast("array<int>"))


def rejection(c: Column) -> Column:
    """102 or 103 by the statute named, else by keyword. Patterns, keywords and their order are fixed values."""
    return (
        F.when(c.rlike(r"(?i)35\s*U\.?S\.?C\.?\s*§?\s*102|§?\s*102\s*\("), "102")
        .when(c.rlike(r"(?i)35\s*U\.?S\.?C\.?\s*§?\s*103|§?\s*103\s*\("), "103")
        .when(F.lower(c).rlike("anticipat|anticpat"), "102")
        .when(F.lower(c).contains("obvious"), "103")
    )


def claim_kind(c: Column) -> Column:
    """Category of a claim by ordered keyword rules. Keywords and their order are fixed values."""
    t = F.lower(c)
    return (
        F.when(t.rlike("^(a method|a process|method of|process of)"), "method")
        .when(t.rlike("antibod|immunoglobulin"), "antibody")
        .when(t.rlike("composition|formulation"), "composition")
        .when(t.contains("compound") & t.rlike("formula|structure"), "compound")
        .when(t.rlike("nucleic acid|polynucleotide|dna"), "nucleic_acid")
        .when(t.rlike("use of|use in"), "use")
        .when(t.rlike("system|apparatus"), "system")
        .when(t.contains("device"), "device")
        .otherwise("unknown")
    )


def segment_kind(c: Column) -> Column:
    """Part a segment plays in a claim. Keywords and their order are fixed values."""
    t = F.lower(c)
    return F.when(t.rlike("comprising|consisting|including"), "preamble").when(t.rlike("administering|contacting|treating|mixing"), "active_step").when(t.rlike("wherein|where|such that"), "condition").otherwise("component")


CAT = Catalogue()
queries, oracle_sql = CAT.queries, CAT.oracle_sql


def _raw(spark, d):
    return table(spark, d, "parsed_citations").select("citation_id", "raw_text").where("raw_text is not null").distinct()


def _sql_first(col: str, patterns: list[str], flags: str = "(?i)") -> str:
    parts = []
    for p in patterns:
        q = p.replace("'", "''")
        parts.append(f"nullif(regexp_extract({col}, '{flags}{q}', 1), '')")
    return f"coalesce({', '.join(parts)})"


_RAW = "WITH r AS (SELECT DISTINCT citation_id, raw_text FROM parsed_citations WHERE raw_text IS NOT NULL)\n"
_SQL_DOI = f"regexp_replace({_sql_first('raw_text', DOI)}, '[.,;)\\]]+$', '')"
_SQL_TITLE = f"trim({_sql_first('raw_text', [QUOTED, AFTER_NAME], '')})"
_SQL_LEAD = _sql_first("raw_text", [ET_AL], "")
_SQL_LIST = f"list_filter(list_transform(regexp_split_to_array({_sql_first('raw_text', [NAMES], '')}, ',\\s*(?:and\\s+)?'), lambda x: trim(x)), lambda x: x <> '')"
_SQL_AUTHORS = f"CASE WHEN {_SQL_LEAD} IS NOT NULL THEN [{_SQL_LEAD}] ELSE {_SQL_LIST} END"


@CAT.query("fn_npl_pmid", _RAW + f"SELECT citation_id, {_sql_first('raw_text', PMID)} AS pmid FROM (SELECT citation_id, raw_text || ' PMID: ' || (30000000 + citation_id) AS raw_text FROM r)")
def _pmid(spark, d):
    r = _raw(spark, d).withColumn("raw_text", F.concat("raw_text", F.lit(" PMID: "), (F.col("citation_id") + 30000000).cast("string")))
    return r.select("citation_id", pmid(F.col("raw_text")).alias("pmid"))


@CAT.query("fn_npl_doi", _RAW + f"SELECT citation_id, {_SQL_DOI} AS doi FROM (SELECT citation_id, raw_text || ' doi:10.1000/x.' || citation_id || ').' AS raw_text FROM r)")
def _doi(spark, d):
    r = _raw(spark, d).withColumn("raw_text", F.concat("raw_text", F.lit(" doi:10.1000/x."), F.col("citation_id").cast("string"), F.lit(").")))
    return r.select("citation_id", doi(F.col("raw_text")).alias("doi"))


@CAT.query("fn_npl_year", _RAW + f"SELECT citation_id, TRY_CAST({_sql_first('raw_text', [YEAR], '')} AS INT) AS year FROM r")
def _year(spark, d):
    return _raw(spark, d).select("citation_id", year(F.col("raw_text")).alias("year"))


@CAT.query("fn_npl_title", _RAW + f"SELECT citation_id, {_SQL_TITLE} AS title FROM r")
def _title(spark, d):
    return _raw(spark, d).select("citation_id", title(F.col("raw_text")).alias("title"))


@CAT.query("fn_npl_authors", _RAW + f"SELECT citation_id, array_to_string({_SQL_AUTHORS}, '|') AS authors FROM r")
def _authors(spark, d):
    return _raw(spark, d).select("citation_id", F.array_join(authors(F.col("raw_text")), "|").alias("authors"))


@CAT.query("fn_npl_parse", _RAW + f""", p AS (SELECT citation_id, {_sql_first('raw_text', PMID)} AS pmid, {_SQL_DOI} AS doi, TRY_CAST({_sql_first('raw_text', [YEAR], '')} AS INT) AS year, {_SQL_TITLE} AS title, {_SQL_AUTHORS} AS a FROM r)
SELECT citation_id, pmid, doi, year, title, CASE WHEN pmid IS NOT NULL THEN 'pmid' WHEN doi IS NOT NULL THEN 'doi' WHEN title IS NOT NULL OR a IS NOT NULL THEN 'bibliographic' ELSE 'none' END AS parse_method FROM p""")
def _parse(spark, d):
    t = F.col("raw_text")
    p = _raw(spark, d).select("citation_id", pmid(t).alias("pmid"), doi(t).alias("doi"), year(t).alias("year"), title(t).alias("title"), authors(t).alias("a"))
    return p.select("citation_id", "pmid", "doi", "year", "title", method(F.col("pmid"), F.col("doi"), F.col("title"), F.col("a")).alias("parse_method"))


@CAT.query("fn_norm_doi", "SELECT DISTINCT doi, trim(regexp_replace(lower('https://doi.org/' || upper(doi)), '^https?://(?:dx\\.)?doi\\.org/', '')) AS doi_key FROM papers WHERE doi IS NOT NULL")
def _doi_key(spark, d):
    return table(spark, d, "papers").where("doi is not null").select("doi").distinct().select("doi", doi_key(F.concat(F.lit("https://doi.org/"), F.upper("doi"))).alias("doi_key"))


_TK = r"trim(regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))"


@CAT.query("fn_norm_title", f"SELECT DISTINCT title, CASE WHEN length({_TK}) > 10 THEN {_TK} END AS title_key FROM parsed_citations WHERE title IS NOT NULL")
def _title_key(spark, d):
    return table(spark, d, "parsed_citations").where("title is not null").select("title").distinct().select("title", title_key(F.col("title")).alias("title_key"))


_PAR = f"TRY_CAST({_sql_first('text', DEPENDENT)} AS INT)"


@CAT.query("fn_claim_type", f"SELECT query_no, {_PAR} AS depends_on, CASE WHEN {_PAR} IS NULL THEN 'independent' ELSE 'dependent' END AS claim_type FROM queries WHERE text IS NOT NULL")
def _claim_type(spark, d):
    q = table(spark, d, "queries").where("text is not null").select("query_no", parent_claim(F.col("text")).alias("depends_on"))
    return q.select("query_no", "depends_on", F.when(F.col("depends_on").isNull(), "independent").otherwise("dependent").alias("claim_type"))


@CAT.query("fn_claim_kind", """SELECT query_no, CASE WHEN regexp_matches(t, '^(a method|a process|method of|process of)') THEN 'method' WHEN regexp_matches(t, 'antibod|immunoglobulin') THEN 'antibody' WHEN regexp_matches(t, 'composition|formulation') THEN 'composition'
 WHEN contains(t, 'compound') AND regexp_matches(t, 'formula|structure') THEN 'compound' WHEN regexp_matches(t, 'nucleic acid|polynucleotide|dna') THEN 'nucleic_acid' WHEN regexp_matches(t, 'use of|use in') THEN 'use'
 WHEN regexp_matches(t, 'system|apparatus') THEN 'system' WHEN contains(t, 'device') THEN 'device' ELSE 'unknown' END AS claim_kind FROM (SELECT query_no, lower(text) AS t FROM queries WHERE text IS NOT NULL)""")
def _claim_kind(spark, d):
    return table(spark, d, "queries").where("text is not null").select("query_no", claim_kind(F.col("text")).alias("claim_kind"))


@CAT.query("fn_claim_numbers", r"""WITH q AS (SELECT query_no, regexp_extract_all(text, '(?i)claims?\s+((?:\d+\s*(?:-\s*\d+)?)(?:\s*(?:,|and|,\s*and)\s*\d+\s*(?:-\s*\d+)?)*)', 1) AS runs FROM queries WHERE text IS NOT NULL),
p AS (SELECT query_no, unnest(string_split(regexp_replace(regexp_replace(array_to_string(runs, ','), '(?i)\s*,?\s*and\s+', ',', 'g'), '\s+', '', 'g'), ',')) AS x FROM q),
n AS (SELECT query_no, unnest(range(TRY_CAST(regexp_extract(x, '^(\d{1,6})', 1) AS BIGINT), TRY_CAST(regexp_extract(x, '(\d{1,6})$', 1) AS BIGINT) + 1)) AS k FROM p WHERE regexp_matches(x, '^\d{1,6}(-\d{1,6})?$'))
SELECT query_no, k::INT AS claim FROM n GROUP BY ALL""")
def _claim_numbers(spark, d):
    return table(spark, d, "queries").where("text is not null").select("query_no", F.explode(claim_numbers(F.col("text"))).alias("claim"))


@CAT.query("fn_claims_list", r"""WITH p AS (SELECT citation_id, unnest(string_split(regexp_replace(pages, '\s+', '', 'g'), ',')) AS x FROM (SELECT DISTINCT citation_id, replace(pages, '–', '-') AS pages FROM parsed_citations WHERE pages IS NOT NULL)),
n AS (SELECT citation_id, TRY_CAST(regexp_extract(x, '^(\d{1,6})', 1) AS BIGINT) AS lo, TRY_CAST(regexp_extract(x, '(\d{1,6})$', 1) AS BIGINT) AS hi FROM p WHERE regexp_matches(x, '^\d{1,6}(-\d{1,6})?$'))
SELECT citation_id, min(lo)::INT AS first_page, max(hi)::INT AS last_page, sum(hi - lo + 1)::INT AS n_pages FROM n WHERE lo <= hi GROUP BY 1""")
def _claims_list(spark, d):
    p = table(spark, d, "parsed_citations").where("pages is not null").select("citation_id", F.regexp_replace("pages", "–", "-").alias("pages")).distinct()
    p = p.withColumn("k", ranges(F.col("pages"))).where(F.size("k") > 0)
    return p.select("citation_id", F.get("k", F.lit(0)).alias("first_page"), F.element_at("k", -1).alias("last_page"), F.size("k").alias("n_pages"))


@CAT.query("fn_rejection_type", r"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)35\s*U\.?S\.?C\.?\s*§?\s*102|§?\s*102\s*\(') THEN '102' WHEN regexp_matches(text, '(?i)35\s*U\.?S\.?C\.?\s*§?\s*103|§?\s*103\s*\(') THEN '103'
 WHEN regexp_matches(lower(text), 'anticipat|anticpat') THEN '102' WHEN contains(lower(text), 'obvious') THEN '103' END AS rejection FROM documents WHERE text IS NOT NULL""")
def _rejection(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", rejection(F.col("text")).alias("rejection"))


@CAT.query("fn_claim_segments", r"""WITH p AS (SELECT query_no, regexp_split_to_array(text, '[;,]\s*(?:and\s+)?') AS a FROM queries WHERE text IS NOT NULL),
u AS (SELECT query_no, unnest(range(1, len(a) + 1)) AS i, trim(unnest(a)) AS s FROM p)
SELECT query_no, i::INT AS element, s AS segment, CASE WHEN regexp_matches(lower(s), 'comprising|consisting|including') THEN 'preamble' WHEN regexp_matches(lower(s), 'administering|contacting|treating|mixing') THEN 'active_step'
 WHEN regexp_matches(lower(s), 'wherein|where|such that') THEN 'condition' ELSE 'component' END AS kind FROM u WHERE length(s) >= 10""")
def _segments(spark, d):
    q = table(spark, d, "queries").where("text is not null").select("query_no", F.posexplode(F.split("text", r"[;,]\s*(?:and\s+)?")).alias("i", "s"))
    q = q.select("query_no", (F.col("i") + 1).alias("element"), F.trim("s").alias("segment")).where(F.length("segment") >= 10)
    return q.withColumn("kind", segment_kind(F.col("segment")))


@CAT.query("fn_extract_seq", r"""SELECT doc_id, coalesce(nullif(regexp_extract(text, '\b([ACDEFGHIKLMNPQRSTVWY]{10,})\b', 1), ''), nullif(regexp_extract(text, '\b([ACGTU]{15,})\b', 1), '')) AS sequence FROM documents WHERE text IS NOT NULL""")
def _sequences(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", first_of(t, [r"\b([ACDEFGHIKLMNPQRSTVWY]{10,})\b", r"\b([ACGTU]{15,})\b"], "").alias("sequence"))


@CAT.query("fn_extract_smiles", r"""SELECT DISTINCT smiles, nullif(regexp_extract('a compound, SMILES: ' || smiles || ', in water', '(?i)SMILES[:\s]*([^\s,;]+)', 1), '') AS found FROM chemical_hits WHERE smiles IS NOT NULL""")
def _smiles(spark, d):
    s = table(spark, d, "chemical_hits").where("smiles is not null").select("smiles").distinct()
    return s.select("smiles", first_of(F.concat(F.lit("a compound, SMILES: "), "smiles", F.lit(", in water")), [r"SMILES[:\s]*([^\s,;]+)"]).alias("found"))


@CAT.query("join_priority_lookup", f"""WITH p AS (SELECT paper_id, max(pmid) AS pmid, max(doi) AS doi, max(title) AS title FROM papers GROUP BY 1),
bp AS (SELECT pmid, max(paper_id) AS by_pmid FROM p WHERE pmid IS NOT NULL GROUP BY 1), bd AS (SELECT lower(doi) AS k, max(paper_id) AS by_doi FROM p WHERE doi IS NOT NULL GROUP BY 1),
bt AS (SELECT {_TK} AS k, max(paper_id) AS by_title FROM p WHERE title IS NOT NULL AND length({_TK}) > 10 GROUP BY 1),
c AS (SELECT citation_id, max(pmid) AS pmid, max(doi) AS doi, max(title) AS title FROM parsed_citations GROUP BY 1)
SELECT citation_id, coalesce(by_pmid, by_doi, by_title) AS paper_id, CASE WHEN by_pmid IS NOT NULL THEN 'pmid' WHEN by_doi IS NOT NULL THEN 'doi' ELSE 'title' END AS method
FROM c LEFT JOIN bp ON bp.pmid = c.pmid LEFT JOIN bd ON bd.k = lower(c.doi) LEFT JOIN bt ON bt.k = CASE WHEN length({_TK}) > 10 THEN {_TK} END WHERE coalesce(by_pmid, by_doi, by_title) IS NOT NULL""")
def _lookup(spark, d):
    p = table(spark, d, "papers").groupBy("paper_id").agg(F.max("pmid").alias("pmid"), F.max("doi").alias("doi"), F.max("title").alias("title"))
    c = table(spark, d, "parsed_citations").groupBy("citation_id").agg(F.max("pmid").alias("pmid"), F.max("doi").alias("doi"), F.max("title").alias("title"))
    c = c.select("citation_id", "pmid", doi_key(F.col("doi")).alias("dk"), title_key(F.col("title")).alias("tk"))
    bp = p.where("pmid is not null").groupBy("pmid").agg(F.max("paper_id").alias("by_pmid"))
    bd = p.where("doi is not null").groupBy(doi_key(F.col("doi")).alias("dk")).agg(F.max("paper_id").alias("by_doi"))
    bt = p.select(title_key(F.col("title")).alias("tk"), "paper_id").where("tk is not null").groupBy("tk").agg(F.max("paper_id").alias("by_title"))
    j = c.join(bp, "pmid", "left").join(bd, "dk", "left").join(bt, "tk", "left")
    m = F.when(F.col("by_pmid").isNotNull(), "pmid").when(F.col("by_doi").isNotNull(), "doi").otherwise("title")
    return j.select("citation_id", F.coalesce("by_pmid", "by_doi", "by_title").alias("paper_id"), m.alias("method")).where("paper_id is not null")


