"""Identifiers of papers, patents, sequences and chemicals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import Catalogue
from ..sources.tables import table

#: Jurisdictions (fixed values).
JURISDICTIONS = ("US", "EP", "WO", "JP", "CN", "KR", "GB", "DE", "FR", "CA", "AU")
_HEAD = "^(" + "|".join(JURISDICTIONS) + ")"


def work_id(c: Column) -> Column:
    """Short form of a work id: the tail of a URL; bare digits get the prefix W."""
    t = F.trim(c)
    return F.when(t.startswith("https://"), F.element_at(F.split(t, "/"), -1)).when(t.rlike(r"^[0-9]+$"), F.concat(F.lit("W"), t)).otherwise(t)


def patent(c: Column) -> Column:
    """STRUCT<jurisdiction, number, kind> of a patent id in any usual spelling. Unknown
    jurisdictions give ``UNKNOWN``, a missing kind null; US numbers of up to seven digits lose
    leading zeros. Null or empty ids give UNKNOWN and an empty number."""
    up = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    found = F.regexp_extract(up, _HEAD, 1)
    rest = F.regexp_replace(F.regexp_replace(up, _HEAD + r"\s*", ""), r"[\s,/\-]", "")
    kind = F.regexp_extract(rest, r"([A-Z][0-9]?)$", 1)
    number = F.regexp_replace(rest, r"[A-Z][0-9]?$", "")
    bare = F.regexp_replace(number, "^0+", "")
    short = (found == "US") & (F.length(number) <= 7)
    number = F.when(short, F.when(bare == "", "0").otherwise(bare)).otherwise(number)
    number = F.when(up == "", F.lit("")).otherwise(number)
    return F.struct(F.when(found == "", "UNKNOWN").otherwise(found).alias("jurisdiction"), number.alias("number"), F.nullif(kind, F.lit("")).alias("kind"))


def family_key(p: Column) -> Column:
    """Jurisdiction and number: the same for all publications of one patent."""
    return F.concat(p["jurisdiction"], p["number"])


def formatted(p: Column, style: str = "compact") -> Column:
    """compact US1234567A1, spaced US 1234567 A1, full US 1,234,567 A1."""
    if style == "compact":
        return F.concat(p["jurisdiction"], p["number"], F.coalesce(p["kind"], F.lit("")))
    number = p["number"]
    if style == "full":
        number = F.when((p["jurisdiction"] == "US") & number.rlike("^[0-9]+$"), F.format_number(F.expr("1") * number.try_cast("bigint"), 0)).otherwise(number)
    return F.concat_ws(" ", p["jurisdiction"], number, p["kind"])


def document_type(p: Column) -> Column:
    """application, grant, correction, design or other, by the kind's letter."""
    k = F.substring(F.coalesce(p["kind"], F.lit("")), 1, 1)
    return F.when(k == "A", "application").when(k == "B", "grant").when(k == "C", "correction").when(k == "S", "design").otherwise("other")


def invalid(c: Column, p: Column) -> Column:
    """Why an id isn't valid, null if it is."""
    digits = p["number"].rlike("^[0-9]+$")
    return (
        F.when(c.isNull() | (F.trim(c) == ""), "empty")
        .when(p["jurisdiction"] == "UNKNOWN", "jurisdiction")
        .when(p["number"] == "", "no number")
        .when(F.length(p["number"]) < 4, "too short")
        .when(p["jurisdiction"].isin("US", "EP", "WO") & ~digits, "not numeric")
        .when((p["jurisdiction"] == "US") & (F.length(p["number"]) > 11), "length")
    )


def sequence_hash(c: Column) -> Column:
    """16 hex digits of the SHA-256 of the sequence in upper case without gaps."""
    return F.substring(F.sha2(F.regexp_replace(F.upper(c), r"[-*]", ""), 256), 1, 16)


def chemical_id(smiles: Column) -> Column:
    """27 hex digits of the SHA-256 of the structure, where no InChIKey is at hand."""
    return F.substring(F.sha2(smiles, 256), 1, 27)


CAT = Catalogue()
queries, oracle_sql = CAT.queries, CAT.oracle_sql


def _ids(spark: SparkSession, d: str):
    return table(spark, d, "relevance_judgments").select("doc_id").where("doc_id is not null").distinct()


_P = f"""WITH i AS (SELECT DISTINCT doc_id FROM relevance_judgments WHERE doc_id IS NOT NULL), u AS (SELECT doc_id, upper(trim(doc_id)) AS up FROM i),
f AS (SELECT *, regexp_extract(up, '{_HEAD}', 1) AS j, regexp_replace(regexp_replace(up, '{_HEAD}\\s*', ''), '[\\s,/\\-]', '', 'g') AS rest FROM u),
k AS (SELECT *, nullif(regexp_extract(rest, '([A-Z][0-9]?)$', 1), '') AS kind, regexp_replace(rest, '[A-Z][0-9]?$', '') AS n FROM f),
p AS (SELECT doc_id, CASE WHEN j = '' THEN 'UNKNOWN' ELSE j END AS jurisdiction, CASE WHEN up = '' THEN '' WHEN j = 'US' AND length(n) <= 7 THEN coalesce(nullif(regexp_replace(n, '^0+', ''), ''), '0') ELSE n END AS number, kind FROM k)
"""


@CAT.query("fn_norm_patent_id", _P + "SELECT doc_id, jurisdiction, number, kind FROM p")
def _norm(spark, d):
    p = patent(F.col("doc_id"))
    return _ids(spark, d).select("doc_id", p["jurisdiction"].alias("jurisdiction"), p["number"].alias("number"), p["kind"].alias("kind"))


@CAT.query("fn_patent_canonical", _P + "SELECT doc_id, jurisdiction || number AS family FROM p")
def _canonical(spark, d):
    return _ids(spark, d).select("doc_id", family_key(patent(F.col("doc_id"))).alias("family"))


@CAT.query("fn_patent_format", _P + """SELECT doc_id, jurisdiction || number || coalesce(kind, '') AS compact, concat_ws(' ', jurisdiction, number, kind) AS spaced,
 concat_ws(' ', jurisdiction, CASE WHEN jurisdiction = 'US' AND regexp_matches(number, '^[0-9]+$') THEN format('{:,}', number::BIGINT) ELSE number END, kind) AS full_form FROM p""")
def _format(spark, d):
    p = patent(F.col("doc_id"))
    return _ids(spark, d).select("doc_id", formatted(p).alias("compact"), formatted(p, "spaced").alias("spaced"), formatted(p, "full").alias("full_form"))


@CAT.query("fn_patent_doctype", _P + "SELECT doc_id, CASE substr(coalesce(kind, ''), 1, 1) WHEN 'A' THEN 'application' WHEN 'B' THEN 'grant' WHEN 'C' THEN 'correction' WHEN 'S' THEN 'design' ELSE 'other' END AS document_type FROM p")
def _doctype(spark, d):
    return _ids(spark, d).select("doc_id", document_type(patent(F.col("doc_id"))).alias("document_type"))


@CAT.query("fn_patent_validate", _P + """SELECT doc_id, CASE WHEN trim(doc_id) = '' THEN 'empty' WHEN jurisdiction = 'UNKNOWN' THEN 'jurisdiction' WHEN number = '' THEN 'no number' WHEN length(number) < 4 THEN 'too short'
 WHEN jurisdiction IN ('US', 'EP', 'WO') AND NOT regexp_matches(number, '^[0-9]+$') THEN 'not numeric' WHEN jurisdiction = 'US' AND length(number) > 11 THEN 'length' END AS invalid FROM p""")
def _validate(spark, d):
    return _ids(spark, d).select("doc_id", invalid(F.col("doc_id"), patent(F.col("doc_id"))).alias("invalid"))


@CAT.query("fn_jurisdiction", _P + "SELECT jurisdiction, count(*) AS n FROM p GROUP BY 1")
def _jurisdiction(spark, d):
    return _ids(spark, d).groupBy(patent(F.col("doc_id"))["jurisdiction"].alias("jurisdiction")).agg(F.count(F.lit(1)).alias("n"))


@CAT.query("dst_patent_ids", _P + ", x AS (SELECT doc_id, jurisdiction || number AS family, row_number() OVER (PARTITION BY jurisdiction || number ORDER BY doc_id) AS r FROM p) SELECT doc_id, family FROM x WHERE r = 1")
def _dedupe(spark, d):
    # the first by order of ids: a minimum, so no window and a map-side combine
    return _ids(spark, d).groupBy(family_key(patent(F.col("doc_id"))).alias("family")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "family")


@CAT.query("fn_norm_openalex", "SELECT DISTINCT paper_id, CASE WHEN starts_with(trim(paper_id), 'https://') THEN split_part(trim(paper_id), '/', -1) WHEN regexp_matches(trim(paper_id), '^[0-9]+$') THEN 'W' || trim(paper_id) ELSE trim(paper_id) END AS work_id FROM (SELECT paper_id FROM papers UNION ALL SELECT substr(paper_id, 2) FROM papers UNION ALL SELECT 'https://x.org/' || paper_id FROM papers)")
def _work(spark, d):
    p = table(spark, d, "papers").select("paper_id")
    every = p.select(F.explode(F.array("paper_id", F.expr("substring(paper_id, 2)"), F.concat(F.lit("https://x.org/"), "paper_id"))).alias("paper_id"))
    return every.distinct().select("paper_id", work_id(F.col("paper_id")).alias("work_id"))


@CAT.query("fn_seq_hash", "SELECT DISTINCT smiles, substr(sha256(regexp_replace(upper(smiles), '[-*]', '', 'g')), 1, 16) AS sequence_hash FROM chemical_hits WHERE smiles IS NOT NULL")
def _seq_hash(spark, d):
    return table(spark, d, "chemical_hits").where("smiles is not null").select("smiles").distinct().select("smiles", sequence_hash(F.col("smiles")).alias("sequence_hash"))


@CAT.query("fn_chem_id", "SELECT DISTINCT smiles, substr(sha256(smiles), 1, 27) AS chemical_key FROM chemical_hits WHERE smiles IS NOT NULL")
def _chem_id(spark, d):
    return table(spark, d, "chemical_hits").where("smiles is not null").select("smiles").distinct().select("smiles", chemical_id(F.col("smiles")).alias("chemical_key"))
