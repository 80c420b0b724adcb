"""Nested records of public registers (JSON, XML) to flat tables, with explicit schemas.

Each parser takes a frame with one record per row in ``value`` and works by
built-in expressions. Defined cases: a record that can't be parsed gives no
row; a missing field gives null or the stated empty value; an element that
stands alone where a list is meant counts as a list of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_id
from ..plans.catalog import Catalogue, rel, withs
from .tables import table

CAT = Catalogue()
queries, oracle_sql = CAT.queries, CAT.oracle_sql

WORK = (
    "id string, title string, publication_date string, cited_by_count int, abstract_inverted_index map<string, array<int>>, ids struct<pmid: string, doi: string>,"
    " concepts array<struct<id: string, display_name: string, score: double>>, authorships array<struct<author: struct<display_name: string>>>, primary_location struct<source: struct<display_name: string>>"
)
PATENT = (
    "patent_id string, patent_title string, patent_date string, ipc_current array<struct<ipc_class: string>>, application array<struct<earliest_application_date: string, application_date: string>>,"
    " claims array<struct<claim_number: int, claim_text: string>>"
)


def tail(c: Column) -> Column:
    """What follows the last slash of an address; other ids as they are."""
    return F.when(c.startswith("https://"), F.substring_index(c, "/", -1)).otherwise(c)


def text_of_index(c: Column) -> Column:
    """A text from its inverted index (word to positions); null and empty give ''."""
    at = F.flatten(F.transform(F.map_entries(c), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(at), lambda x: x["w"]), " "), F.lit(""))


def index_of_text(c: Column) -> Column:
    """The inverted index of a text: word to positions."""
    w = F.split(F.trim(c), r"\s+")
    return F.map_from_arrays(F.array_distinct(w), F.transform(F.array_distinct(w), lambda x: F.filter(F.transform(w, lambda y, i: F.when(y == x, i)), lambda i: i.isNotNull())))


def works(d: DataFrame) -> DataFrame:
    """Bibliographic work records to the columns of a paper."""
    w = d.select(F.from_json("value", WORK).alias("w")).where("w.id is not null")
    f = lambda c: F.col(f"w.{c}")
    doi = F.regexp_replace(f("ids.doi"), "^https://doi.org/", "")
    return w.select(
        tail(f("id")).alias("paper_id"),
        F.nullif(tail(f("ids.pmid")), F.lit("")).alias("pmid"),
        F.nullif(doi, F.lit("")).alias("doi"),
        F.coalesce(f("title"), F.lit("")).alias("title"),
        text_of_index(f("abstract_inverted_index")).alias("abstract"),
        f("publication_date").alias("publication_date"),
        F.nullif(f("primary_location.source.display_name"), F.lit("")).alias("journal"),
        F.transform(F.coalesce(f("authorships"), F.array()), lambda a: F.coalesce(a["author"]["display_name"], F.lit(""))).alias("authors"),
        F.transform(F.coalesce(f("concepts"), F.array()), lambda c: F.struct(F.substring_index(c["id"], "/", -1).alias("id"), c["display_name"].alias("name"), c["score"].alias("score"))).alias("concepts"),
        F.coalesce(f("cited_by_count"), F.lit(0)).alias("cited_by_count"),
    )


def patents(d: DataFrame) -> DataFrame:
    """Patent records to a table: ipc codes as a list, the first application's dates, claims as structs."""
    p = d.select(F.from_json("value", PATENT).alias("p")).where("p.patent_id is not null")
    first = F.get("p.application", F.lit(0))
    codes = F.filter(F.transform(F.coalesce("p.ipc_current", F.array()), lambda x: x["ipc_class"]), lambda c: c.isNotNull())
    return p.select("p.patent_id", F.col("p.patent_title").alias("title"), "p.patent_date", first["earliest_application_date"].alias("priority_date"), first["application_date"].alias("filing_date"), codes.alias("ipc_codes"), F.coalesce("p.claims", F.array()).alias("claims"))


def claim_numbers(c: Column) -> Column:
    """Claim numbers of a list such as ``1-3, 5``, in order and once each; other parts are skipped."""
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), r"\s*[,;]\s*"), lambda x: x.rlike(r"^\d+(\s*-\s*\d+)?$"))
    ends = F.transform(parts, lambda x: F.transform(F.split(x, r"\s*-\s*"), lambda y: y.cast("int")))
    ranges = F.transform(F.filter(ends, lambda e: F.element_at(e, -1) >= F.element_at(e, 1)), lambda e: F.sequence(F.element_at(e, 1), F.element_at(e, -1)))
    return F.array_sort(F.array_distinct(F.flatten(ranges)))


_CITATION = "`@category` string, `reg:rel-claims` string, `reg:patcit` struct<`document-id`: struct<country: struct<`$`: string>, `doc-number`: struct<`$`: string>, kind: struct<`$`: string>>>, `reg:nplcit` struct<text: struct<`$`: string>>"
_ROOT = "$['ops:world-patent-data']['ops:register-search']['reg:register-documents']['reg:register-document']"


def listed(json: Column) -> Column:
    """A JSON value as a JSON list: a value that stands alone becomes a list of one."""
    return F.when(F.ltrim(json).startswith("["), json).when(json.isNotNull(), F.concat(F.lit("["), json, F.lit("]")))


def search_reports(d: DataFrame) -> DataFrame:
    """(application_number, date, category, cited, is_patent, claims): a row per citation of register
    answers in JSON; the first document of each answer counts."""
    doc = d.select(F.get_json_object(listed(F.get_json_object("value", _ROOT)), "$[0]").alias("doc")).where("doc is not null")
    data = doc.select(
        F.coalesce(F.get_json_object("doc", "$['reg:bibliographic-data']['reg:application-reference']['document-id']['doc-number']['$']"), F.lit("")).alias("application_number"),
        F.coalesce(F.get_json_object("doc", "$['reg:search-report-data']['reg:search-report-date']['$']"), F.lit("")).alias("date"),
        F.explode(F.from_json(listed(F.get_json_object("doc", "$['reg:search-report-data']['reg:citation']")), f"array<struct<{_CITATION}>>")).alias("c"),
    )
    p = lambda k: F.coalesce(F.col(f"c.`reg:patcit`.`document-id`.{k}.`$`"), F.lit(""))
    return _citations(data, F.col("c.`@category`"), F.col("c.`reg:patcit`").isNotNull(), F.concat(p("country"), p("`doc-number`"), p("kind")), F.col("c.`reg:nplcit`.text.`$`"), F.col("c.`reg:rel-claims`"))


_REPORT = "`search-report` struct<_date: string, `application-reference`: struct<`document-id`: struct<country: string, `doc-number`: string>>, citation: array<struct<_category: string, `rel-claims`: string, patcit: struct<`document-id`: struct<country: string, `doc-number`: string, kind: string>>, nplcit: struct<text: string>>>>"


def search_reports_xml(d: DataFrame) -> DataFrame:
    """The same rows from answers in XML; prefixes of names don't matter."""
    x = d.select(F.from_xml("value", _REPORT, {"ignoreNamespace": "true", "attributePrefix": "_", "rowTag": "world-patent-data"}).alias("x")).select("x.search-report").where("`search-report` is not null")
    r = x.select(F.col("search-report").alias("r"))
    number = F.concat(*(F.coalesce(F.col(f"r.`application-reference`.`document-id`.{k}"), F.lit("")) for k in ("country", "`doc-number`")))
    data = r.select(number.alias("application_number"), F.coalesce("r._date", F.lit("")).alias("date"), F.explode("r.citation").alias("c"))
    p = lambda k: F.coalesce(F.col(f"c.patcit.`document-id`.{k}"), F.lit(""))
    return _citations(data, F.col("c._category"), F.col("c.patcit").isNotNull(), F.concat(p("country"), p("`doc-number`"), p("kind")), F.col("c.nplcit.text"), F.col("c.`rel-claims`"))


def _citations(data: DataFrame, category: Column, patent: Column, number: Column, text: Column, claims: Column) -> DataFrame:
    return data.select("application_number", "date", F.coalesce(category, F.lit("A")).alias("category"), F.when(patent, number).otherwise(F.coalesce(text, F.lit(""))).alias("cited"), patent.alias("is_patent"), claim_numbers(claims).alias("claims"))


_HSP = "`Hsp_align-len` int, Hsp_identity int, `Hsp_query-from` int, `Hsp_query-to` int, Hsp_gaps int, `Hsp_hit-from` int, `Hsp_hit-to` int, Hsp_evalue double, `Hsp_bit-score` double"
_BLAST = f"BlastOutput_iterations struct<Iteration: array<struct<`Iteration_query-def`: string, `Iteration_query-len`: int, Iteration_hits: struct<Hit: array<struct<Hit_id: string, Hit_hsps: struct<Hsp: array<struct<{_HSP}>>>>>>>>>"


def alignments(d: DataFrame) -> DataFrame:
    """A row per aligned pair of search answers in XML: percent identity and share of the query are
    computed, mismatches are the aligned places that neither match nor are gaps."""
    it = d.select(F.from_xml("value", _BLAST, {"rowTag": "BlastOutput"}).alias("b")).select(F.get("b.BlastOutput_iterations.Iteration", F.lit(0)).alias("i"))
    hit = it.select(F.col("i.`Iteration_query-def`").alias("query_id"), F.col("i.`Iteration_query-len`").alias("n"), F.explode("i.Iteration_hits.Hit").alias("h"))
    hsp = hit.select("query_id", "n", F.col("h.Hit_id").alias("subject_id"), F.explode("h.Hit_hsps.Hsp").alias("s"))
    z = lambda c, v=0: F.coalesce(F.col(f"s.`{c}`"), F.lit(v))
    length = z("Hsp_align-len")
    share = lambda a, b: F.coalesce(F.try_divide(a * 100.0, b), F.lit(0.0))
    return hsp.select(
        "query_id", "subject_id", share(z("Hsp_identity"), length).alias("identity"), length.alias("alignment_length"), (length - z("Hsp_identity") - z("Hsp_gaps")).alias("mismatches"), z("Hsp_gaps").alias("gap_opens"),
        z("Hsp_query-from").alias("query_start"), z("Hsp_query-to").alias("query_end"), z("Hsp_hit-from").alias("subject_start"), z("Hsp_hit-to").alias("subject_end"),
        z("Hsp_evalue", 999.0).alias("evalue"), z("Hsp_bit-score", 0.0).alias("bit_score"), share(z("Hsp_query-to") - z("Hsp_query-from") + 1, F.coalesce("n", F.lit(0))).alias("query_coverage"),
    )


# --- records made of the given tables, and read again ---------------------------------------


@CAT.query("src_paper_json", """SELECT DISTINCT paper_id, pmid, doi, coalesce(title, '') AS title, CASE WHEN trim(coalesce(abstract, '')) = '' THEN '' ELSE array_to_string(regexp_split_to_array(trim(abstract), '\\s+'), ' ') END AS abstract, journal, len(authors)::INT AS n_authors,
array_to_string(list_transform(concepts, lambda c: c.id || ':' || c.name), '|') AS concepts, coalesce(cited_by_count, 0) AS cited_by_count FROM papers""")
def _papers(spark, d):
    p = table(spark, d, "papers").select("paper_id", "pmid", "doi", "title", "abstract", "journal", "authors", "concepts", "cited_by_count").distinct()
    https = lambda where, c: F.concat(F.lit(where), F.col(c))
    record = F.struct(
        https("https://works.example/", "paper_id").alias("id"), "title", "cited_by_count", F.when(F.trim("abstract") != "", index_of_text(F.col("abstract"))).alias("abstract_inverted_index"),
        F.struct(https("https://ids.example/", "pmid").alias("pmid"), https("https://doi.org/", "doi").alias("doi")).alias("ids"),
        F.transform("concepts", lambda c: F.struct(F.concat(F.lit("https://concepts.example/"), c["id"]).alias("id"), c["name"].alias("display_name"), c["score"].alias("score"))).alias("concepts"),
        F.transform("authors", lambda a: F.struct(F.struct(a.alias("display_name")).alias("author"))).alias("authorships"), F.struct(F.struct(F.col("journal").alias("display_name")).alias("source")).alias("primary_location"),
    )
    w = works(p.select(F.to_json(record).alias("value")))
    return w.select("paper_id", "pmid", "doi", "title", "abstract", "journal", F.size("authors").alias("n_authors"), F.array_join(F.transform("concepts", lambda c: F.concat(c["id"], F.lit(":"), c["name"])), "|").alias("concepts"), "cited_by_count")


_CLAIMS = "SELECT split_part(clean_id(_id), '-', 1) AS patent_id, regexp_extract(clean_id(_id), '-C(\\d+)$', 1)::INT AS claim_number, text, priority_date, ipc_codes FROM queries WHERE regexp_matches(clean_id(_id), '^US\\d+-C\\d+$')"


def claims_of_queries(spark, d) -> DataFrame:
    q = table(spark, d, "queries").select(clean_id("_id").alias("id"), "text", "priority_date", "ipc_codes").where(r"id rlike '^US\\d+-C\\d+$'")
    return q.select(F.split_part("id", F.lit("-"), F.lit(1)).alias("patent_id"), F.regexp_extract("id", r"-C(\d+)$", 1).cast("int").alias("claim_number"), "text", "priority_date", "ipc_codes")


@CAT.query("src_patent_json", f"""WITH q AS ({_CLAIMS}), p AS (SELECT patent_id, min(priority_date) AS priority_date FROM q GROUP BY 1), i AS (SELECT patent_id, string_agg(c, '|' ORDER BY c) AS ipc_codes FROM (SELECT DISTINCT patent_id, unnest(ipc_codes) AS c FROM q) GROUP BY 1)
SELECT DISTINCT patent_id, p.priority_date, coalesce(ipc_codes, '') AS ipc_codes, claim_number, coalesce(text, '') AS claim_text FROM (SELECT patent_id, claim_number, text FROM q) JOIN p USING (patent_id) LEFT JOIN i USING (patent_id)""")
def _patents(spark, d):
    q = claims_of_queries(spark, d)
    g = q.groupBy("patent_id").agg(
        F.array_distinct(F.flatten(F.collect_set(F.coalesce("ipc_codes", F.array())))).alias("codes"), F.min("priority_date").alias("day"), F.collect_set(F.struct("claim_number", F.coalesce("text", F.lit("")).alias("claim_text"))).alias("claims"),
    )
    record = F.struct("patent_id", F.transform("codes", lambda c: F.struct(c.alias("ipc_class"))).alias("ipc_current"), F.array(F.struct(F.col("day").alias("earliest_application_date"))).alias("application"), "claims")
    p = patents(g.select(F.to_json(record).alias("value")))
    return p.select("patent_id", "priority_date", F.array_join(F.array_sort("ipc_codes"), "|").alias("ipc_codes"), F.inline("claims"))


def answers(df: DataFrame, key: str, by: str, most: int = 200) -> DataFrame:
    """``part`` of each row: a key's rows are cut into about as many answers as hold ``most`` each,
    so that no record grows with its key."""
    parts = df.groupBy(key).agg((F.floor(F.count(F.lit(1)) / most) + 1).alias("_parts"))
    return df.join(parts, key).withColumn("part", F.pmod(F.xxhash64(by), F.col("_parts"))).drop("_parts")


def _reports(spark, d) -> DataFrame:
    """Search reports made of the judgments: (query_id, category, patent, country, number, kind, text, claims)."""
    q = rel(spark, d, "qrels")
    part = lambda k: F.regexp_extract("doc_id", "^(US|EP|WO)([0-9]+)([A-Z][0-9]?)?$", k)
    category = F.when(F.col("relevance") == 3, "X").when(F.col("relevance") == 2, "Y").otherwise("A")
    return q.select("query_id", "doc_id", category.alias("category"), (part(1) != "").alias("patent"), part(1).alias("country"), part(2).alias("number"), part(3).alias("kind"), F.concat(F.lit("1-"), (F.col("relevance") + 1).cast("string"), F.lit(", 9")).alias("claims"))


_EP = withs("qrels") + """, r AS (SELECT query_id AS application_number, CASE relevance WHEN 3 THEN 'X' WHEN 2 THEN 'Y' ELSE 'A' END AS category, doc_id AS cited, regexp_matches(doc_id, '^(US|EP|WO)[0-9]+([A-Z][0-9]?)?$') AS is_patent,
CASE relevance WHEN 3 THEN '1,2,3,4,9' WHEN 2 THEN '1,2,3,9' WHEN 1 THEN '1,2,9' ELSE '1,9' END AS claims FROM qrels) """
_EP_ALL = _EP + "SELECT application_number, category, cited, is_patent, claims FROM r"


def reports_json(spark, d) -> DataFrame:
    r = answers(_reports(spark, d), "query_id", "doc_id")
    v = lambda c: F.struct(F.col(c).alias("$"))
    cit = F.struct(
        F.col("category").alias("@category"), F.col("claims").alias("reg:rel-claims"), F.when(F.col("patent"), F.struct(F.struct(v("country").alias("country"), v("number").alias("doc-number"), v("kind").alias("kind")).alias("document-id"))).alias("reg:patcit"),
        F.when(~F.col("patent"), F.struct(v("doc_id").alias("text"))).alias("reg:nplcit"),
    )
    g = r.groupBy("query_id", "part").agg(F.collect_list(F.to_json(cit)).alias("c"))
    cits = F.when(F.size("c") == 1, F.get("c", F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join("c", ","), F.lit("]")))  # one alone isn't a list
    head = F.concat(F.lit('{"ops:world-patent-data":{"ops:register-search":{"reg:register-documents":{"reg:register-document":{"reg:bibliographic-data":{"reg:application-reference":{"document-id":{"doc-number":{"$":"'), F.col("query_id"), F.lit('"}}}},"reg:search-report-data":{"reg:search-report-date":{"$":"20200131"},"reg:citation":'))
    return g.select(F.concat(head, cits, F.lit("}}}}}}")).alias("value"))


def _flat(r: DataFrame) -> DataFrame:
    return r.select("application_number", "category", "cited", "is_patent", F.array_join(F.col("claims").cast("array<string>"), ",").alias("claims"))


@CAT.query("src_ep_json", _EP_ALL)
def _ep_json(spark, d):
    return _flat(search_reports(reports_json(spark, d)))


@CAT.query("src_ep_xml", _EP_ALL)
def _ep_xml(spark, d):
    r = answers(_reports(spark, d), "query_id", "doc_id")
    el = lambda n, c: F.concat(F.lit(f"<{n}>"), F.col(c) if isinstance(c, str) else c, F.lit(f"</{n}>"))
    patent = el("ep:patcit", el("epo:document-id", F.concat(el("epo:country", "country"), el("epo:doc-number", "number"), el("epo:kind", "kind"))))
    cit = F.concat(F.lit('<ep:citation category="'), F.col("category"), F.lit('">'), F.when(F.col("patent"), patent).otherwise(el("ep:nplcit", el("ep:text", "doc_id"))), el("ep:rel-claims", "claims"), F.lit("</ep:citation>"))
    g = r.groupBy("query_id", "part").agg(F.array_join(F.collect_list(cit), "").alias("c"))
    head = F.concat(F.lit('<ops:world-patent-data><ep:search-report date="20200131"><ep:application-reference><epo:document-id><epo:country></epo:country><epo:doc-number>'), F.col("query_id"), F.lit("</epo:doc-number></epo:document-id></ep:application-reference>"))
    return _flat(search_reports_xml(g.select(F.concat(head, F.col("c"), F.lit("</ep:search-report></ops:world-patent-data>")).alias("value"))))


@CAT.query("src_ep_df", _EP + "SELECT application_number, count(*) AS n_citations, count(*) FILTER (WHERE is_patent) AS n_patents, count(*) FILTER (WHERE category = 'X') AS n_x, count(*) FILTER (WHERE category = 'Y') AS n_y FROM r GROUP BY 1")
def _ep_df(spark, d):
    r = search_reports(reports_json(spark, d))
    return r.groupBy("application_number").agg(F.count(F.lit(1)).alias("n_citations"), F.count_if("is_patent").alias("n_patents"), F.count_if(F.col("category") == "X").alias("n_x"), F.count_if(F.col("category") == "Y").alias("n_y"))


@CAT.query("flt_reports_props", _EP + "SELECT application_number, cited, category FROM r WHERE category IN ('X', 'Y') AND is_patent")
def _ep_props(spark, d):
    return search_reports(reports_json(spark, d)).where("category in ('X', 'Y') and is_patent").select("application_number", "cited", "category")


@CAT.query("fn_ep_relevance", _EP + "SELECT application_number AS query_id, cited AS doc_id, greatest(CASE category WHEN 'X' THEN 3 WHEN 'Y' THEN 2 ELSE 1 END, coalesce(score, 0))::INT AS relevance FROM r LEFT JOIN (SELECT clean_id(statement_id) AS application_number, clean_id(doc_id) AS cited, max(relevance_score) AS score FROM relevance_judgments WHERE model = 'brine-lite' AND relevance_score BETWEEN 0 AND 3 GROUP BY 1, 2) USING (application_number, cited)")
def _ep_relevance(spark, d):
    """Category to grade (X 3, Y 2, else 1), and the greater of it and another source's grade."""
    other = rel(spark, d, "judged").where("model = 'brine-lite'").select("query_id", "doc_id", "score")
    r = search_reports(reports_json(spark, d)).select(F.col("application_number").alias("query_id"), F.col("cited").alias("doc_id"), F.when(F.col("category") == "X", 3).when(F.col("category") == "Y", 2).otherwise(1).alias("g"))
    return r.join(other, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.greatest("g", F.coalesce("score", F.lit(0))).alias("relevance"))


_HITS = "query_id IS NOT NULL AND subject_id IS NOT NULL AND alignment_length > 0 AND mismatches >= 0 AND gap_opens >= 0 AND alignment_length > mismatches + gap_opens AND bit_score >= 0 AND NOT isnan(bit_score) AND query_start > 0 AND query_end >= query_start"


@CAT.query("src_blast_xml", f"""WITH h AS (SELECT DISTINCT query_id, subject_id, alignment_length, mismatches, gap_opens, query_start, query_end, bit_score FROM blast_hits WHERE {_HITS})
SELECT query_id, subject_id, round((alignment_length - mismatches - gap_opens)::DOUBLE * 100 / alignment_length, 6) AS identity, alignment_length, mismatches, gap_opens, bit_score, round((query_end - query_start + 1)::DOUBLE * 100 / 1000, 6) AS query_coverage FROM h""")
def _blast(spark, d):
    h = table(spark, d, "blast_hits").where(_HITS).select("query_id", "subject_id", "alignment_length", "mismatches", "gap_opens", "query_start", "query_end", "bit_score").distinct()
    el = lambda n, c: F.concat(F.lit(f"<{n}>"), (F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(f"</{n}>"))
    hsp = F.concat(el("Hsp_align-len", "alignment_length"), el("Hsp_identity", F.col("alignment_length") - F.col("mismatches") - F.col("gap_opens")), el("Hsp_gaps", "gap_opens"), el("Hsp_query-from", "query_start"), el("Hsp_query-to", "query_end"), el("Hsp_bit-score", "bit_score"))
    g = answers(h, "query_id", "subject_id").groupBy("query_id", "part").agg(F.array_join(F.collect_list(el("Hit", F.concat(el("Hit_id", "subject_id"), el("Hit_hsps", el("Hsp", hsp))))), "").alias("hits"))
    xml = el("BlastOutput", el("BlastOutput_iterations", el("Iteration", F.concat(el("Iteration_query-def", "query_id"), F.lit("<Iteration_query-len>1000</Iteration_query-len>"), el("Iteration_hits", "hits")))))
    a = alignments(g.select(xml.alias("value")))
    return a.select("query_id", "subject_id", F.round("identity", 6).alias("identity"), "alignment_length", "mismatches", "gap_opens", "bit_score", F.round("query_coverage", 6).alias("query_coverage"))
