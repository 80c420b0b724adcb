"""Grades from citation evidence, samples by category, and novelty by claim elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_id, words
from ..plans.catalog import Catalogue, rel, withs
from ..sources.records import claims_of_queries
from ..sources.tables import table
from .metrics import _sql, per_query
from .ranking import by_score, hash_order, ranked

CAT = Catalogue()
queries, oracle_sql = CAT.queries, CAT.oracle_sql

#: Names of the grades (fixed values).
LABELS = ("not_relevant", "relevant", "highly_relevant", "novelty_destroying")


def grade(source: Column, confidence: Column, rejection: Column) -> Column:
    """Grade 0 to 3 of a citation: rejected for lack of novelty 3, for obviousness 2; else by who cited
    it and how surely; an office action alone counts 1."""
    examined = source.isin("examiner", "office_action")
    return (
        F.when(rejection == "102", 3).when(rejection == "103", 2).when(examined & (confidence >= 9), 2).when(examined & (confidence >= 7), 1)
        .when((source == "applicant") & (confidence >= 8), 1).when(source == "office_action", 1).otherwise(0)
    )


_OA = ", oa AS (SELECT patent_id, paper_id, CASE min(claim_number) WHEN 1 THEN '102' WHEN 2 THEN '103' ELSE '112' END AS rejection FROM links WHERE source = 'both' GROUP BY 1, 2), lk AS (SELECT patent_id, paper_id, source, max(confidence) AS confidence FROM links WHERE source <> 'both' GROUP BY 1, 2, 3)"


def rejections(links: DataFrame) -> DataFrame:
    """Rejections made of the links found by both sides; the lowest claim stands for the ground."""
    n = F.min("claim_number")
    return links.where("source = 'both'").groupBy("patent_id", "paper_id").agg(F.when(n == 1, "102").when(n == 2, "103").otherwise("112").alias("rejection"))


@CAT.query("fn_graded_rule", withs("links") + _OA + """, g AS (SELECT patent_id, paper_id, CASE rejection WHEN '102' THEN 3 WHEN '103' THEN 2 ELSE CASE WHEN source = 'examiner' AND confidence >= 9 THEN 2 WHEN source = 'examiner' AND confidence >= 7 OR source = 'applicant' AND confidence >= 8 THEN 1 ELSE 0 END END AS relevance FROM lk LEFT JOIN oa USING (patent_id, paper_id)
UNION ALL SELECT patent_id, paper_id, CASE rejection WHEN '102' THEN 3 WHEN '103' THEN 2 ELSE 2 END FROM oa WHERE NOT EXISTS (SELECT 1 FROM lk WHERE lk.patent_id = oa.patent_id AND lk.paper_id = oa.paper_id))
SELECT patent_id, paper_id, max(relevance)::INT AS relevance, ['not_relevant', 'relevant', 'highly_relevant', 'novelty_destroying'][max(relevance) + 1] AS label FROM g GROUP BY 1, 2 HAVING max(relevance) > 0""")
def _graded(spark, d):
    """Citations of the search with rejections merged in (alone, they count as sure); the best grade per pair, if any."""
    links = rel(spark, d, "links")
    oa = rejections(links)
    cited = links.where("source <> 'both'").groupBy("patent_id", "paper_id", "source").agg(F.max("confidence").alias("confidence"))
    alone = oa.join(cited, ["patent_id", "paper_id"], "left_anti").withColumns({"source": F.lit("office_action"), "confidence": F.lit(10)})
    both = cited.join(oa, ["patent_id", "paper_id"], "left").unionByName(alone)
    g = both.groupBy("patent_id", "paper_id").agg(F.max(grade(F.col("source"), F.col("confidence"), F.col("rejection"))).alias("relevance")).where("relevance > 0")
    return g.withColumn("label", F.get(F.array(*(F.lit(x) for x in LABELS)), F.col("relevance")))


@CAT.query("win_keep_max_rel", withs("qrels", "judged") + "SELECT DISTINCT ON (query_id, doc_id) query_id, doc_id, relevance, evidence FROM (SELECT query_id, doc_id, relevance, 'consensus' AS evidence FROM qrels UNION ALL SELECT query_id, doc_id, score, model FROM judged) WHERE relevance > 0 ORDER BY query_id, doc_id, relevance DESC, evidence")
def _keep_max(spark, d):
    """The highest grade per pair with its evidence: a minimum of structs, combined before the shuffle."""
    a = rel(spark, d, "qrels").withColumn("evidence", F.lit("consensus")).unionByName(rel(spark, d, "judged").select("query_id", "doc_id", F.col("score").alias("relevance"), F.col("model").alias("evidence")))
    m = a.where("relevance > 0").groupBy("query_id", "doc_id").agg(F.min(F.struct((-F.col("relevance")).alias("o"), "evidence")).alias("m"))
    return m.select("query_id", "doc_id", (-F.col("m.o")).alias("relevance"), F.col("m.evidence").alias("evidence"))


@CAT.query("top_k_partition", withs("scored") + "SELECT query_id, doc_id, round(score, 6) AS score FROM (SELECT query_id, doc_id, max(score) AS score FROM scored GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) <= 10")
def _partition(spark, d):
    s = rel(spark, d, "scored").groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return ranked(s, ["query_id"], by_score(), 10).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def bucket(recall: Column) -> Column:
    """Difficulty of a query by recall."""
    return F.when(recall < 0.3, "hard").when(recall <= 0.7, "medium").otherwise("easy")


@CAT.query("fn_bucket", _sql([10]) + "SELECT query_id, CASE WHEN round(avg(r_10), 9) < 0.3 THEN 'hard' WHEN round(avg(r_10), 9) <= 0.7 THEN 'medium' ELSE 'easy' END AS difficulty FROM per GROUP BY 1")
def _bucket(spark, d):
    per = per_query(rel(spark, d, "scored"), rel(spark, d, "qrels"), [10])
    return per.groupBy("query_id").agg(bucket(F.round(F.avg("r_10"), 9)).alias("difficulty"))


def delay(attempt: Column, base: float = 2.0, most: float = 60.0) -> Column:
    """Seconds to wait before an attempt, without the random part (up to a quarter more)."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))


@CAT.query("fn_backoff", "SELECT DISTINCT l_linenumber AS attempt, least(2 * 2.0 ** l_linenumber, 60)::DOUBLE AS seconds FROM lineitem")
def _backoff(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_linenumber").alias("attempt")).distinct().withColumn("seconds", delay(F.col("attempt")))


# --- samples by category --------------------------------------------------------------------

#: Shares of the domains in a sample, quotas of the buckets of candidates and of the categories (fixed values).
DOMAIN_SHARES = (("oncology", 40), ("diagnostics", 30), ("enzymes", 30))
CANDIDATE_QUOTAS = (("multi_patent_examiner", 42), ("single_patent_examiner", 30), ("cross_domain", 18), ("applicant_only", 18), ("negative_control", 12))
CATEGORY_QUOTAS = (("multi_patent_examiner", 35), ("single_patent_examiner", 25), ("cross_domain", 15), ("applicant_only", 15), ("negative_control", 10))

_PROFILES = withs("qrels", "q_domain") + """, pr AS (SELECT doc_id, count(DISTINCT query_id) FILTER (WHERE relevance > 0) AS n_patents, count(DISTINCT domain) FILTER (WHERE relevance > 0) AS n_domains, bool_or(relevance >= 2) AS ex, max(relevance) AS best FROM qrels LEFT JOIN q_domain USING (query_id) GROUP BY 1),
dm AS (SELECT doc_id, domain FROM (SELECT doc_id, ifnull(domain, 'unknown') AS domain, count(*) AS k FROM qrels LEFT JOIN q_domain USING (query_id) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, domain) = 1), pf AS (SELECT * FROM pr JOIN dm USING (doc_id)),
mb AS (SELECT doc_id, domain, 1 AS b FROM pf WHERE ex AND n_patents >= 3 UNION ALL SELECT doc_id, domain, 2 FROM pf WHERE ex AND n_patents = 1 UNION ALL SELECT doc_id, domain, 3 FROM pf WHERE n_domains > 1 UNION ALL SELECT doc_id, domain, 4 FROM pf WHERE NOT ex AND best = 1 UNION ALL SELECT doc_id, domain, 5 FROM pf WHERE best = 0)"""


def profiles(spark, d) -> DataFrame:
    """(doc_id, domain, b) once per bucket (1 to 5) that a judged document belongs to. Domain: the commonest of its queries."""
    j = rel(spark, d, "qrels").join(rel(spark, d, "q_domain"), "query_id", "left")
    p = j.groupBy("doc_id").agg(
        F.count_distinct(F.when(F.col("relevance") > 0, F.col("query_id"))).alias("n"), F.count_distinct(F.when(F.col("relevance") > 0, F.col("domain"))).alias("nd"), F.bool_or(F.col("relevance") >= 2).alias("ex"), F.max("relevance").alias("best"),
    )
    k = j.groupBy("doc_id", F.coalesce("domain", F.lit("unknown")).alias("domain")).agg(F.count(F.lit(1)).alias("k"))
    mode = k.groupBy("doc_id").agg(F.min(F.struct((-F.col("k")).alias("k"), "domain")).alias("m")).select("doc_id", "m.domain")
    tests = [F.col("ex") & (F.col("n") >= 3), F.col("ex") & (F.col("n") == 1), F.col("nd") > 1, ~F.col("ex") & (F.col("best") == 1), F.col("best") == 0]
    b = F.filter(F.array(*(F.when(t, F.lit(i + 1)) for i, t in enumerate(tests))), lambda x: x.isNotNull())
    return p.join(mode, "doc_id").select("doc_id", "domain", F.explode(b).alias("b"))


_QUOTAS = [(b + 1, dom, max(1, round(n * s / 100))) for b, (_, n) in enumerate(CANDIDATE_QUOTAS[:4]) for dom, s in DOMAIN_SHARES]


@CAT.query("smp_candidates", _PROFILES + ", qt(b, domain, k) AS (VALUES " + ", ".join(f"({b}, '{x}', {k})" for b, x, k in _QUOTAS) + """), pk AS (SELECT doc_id, b FROM mb JOIN qt USING (b, domain) QUALIFY row_number() OVER (PARTITION BY b, domain ORDER BY md5('42:' || doc_id), doc_id) <= any_value(k) OVER (PARTITION BY b, domain)
UNION ALL (SELECT doc_id, b FROM mb WHERE b = 5 ORDER BY md5('42:' || doc_id), doc_id LIMIT 12)) SELECT doc_id, ['multi_patent_examiner', 'single_patent_examiner', 'cross_domain', 'applicant_only', 'negative_control'][min(b)] AS category FROM pk GROUP BY 1""")
def _candidates(spark, d):
    """Five buckets, each filled by domain; a document in several belongs to the first."""
    m = profiles(spark, d)
    k = F.coalesce(*(F.when((F.col("b") == b) & (F.col("domain") == x), n) for b, x, n in _QUOTAS), F.when(F.col("b") == 5, CANDIDATE_QUOTAS[4][1]), F.lit(0))
    group = m.withColumn("g", F.when(F.col("b") == 5, "").otherwise(F.col("domain"))).withColumn("k", k).where("k > 0")
    kept = ranked(group, ["b", "g"], hash_order("doc_id", 42), max(n for *_, n in _QUOTAS)).where("rank <= k")
    return kept.groupBy("doc_id").agg(F.min("b").alias("b")).select("doc_id", F.get(F.array(*(F.lit(c) for c, _ in CANDIDATE_QUOTAS)), F.col("b") - 1).alias("category"))


@CAT.query("smp_category_trim", _PROFILES + ", ct AS (SELECT doc_id, min(b) AS b FROM mb GROUP BY 1) SELECT doc_id, b FROM ct QUALIFY row_number() OVER (PARTITION BY b ORDER BY md5('42:' || doc_id), doc_id) <= [35, 25, 15, 15, 10][b] ORDER BY b, md5('42:' || doc_id), doc_id LIMIT 100")
def _trim(spark, d):
    """Quotas per category, then the whole cut to 100."""
    c = profiles(spark, d).groupBy("doc_id").agg(F.min("b").alias("b"))
    r = ranked(c, ["b"], hash_order("doc_id", 42), 35).where(F.col("rank") <= F.get(F.array(*(F.lit(n) for _, n in CATEGORY_QUOTAS)), F.col("b") - 1))
    return r.orderBy("b", *hash_order("doc_id", 42)).limit(100).select("doc_id", "b")


def balanced(df: DataFrame, key: str, group: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in proportion to the groups; what rounding leaves goes to the group with the largest
    target, and what a group can't give is filled from the rest."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("m"))
    total = sizes.agg(F.sum("m").alias("t"))
    aims = sizes.crossJoin(F.broadcast(total)).withColumn("aim", F.round(F.lit(float(n)) * F.col("m") / F.col("t")).cast("bigint"))
    fix = aims.agg((F.lit(n) - F.sum("aim")).alias("rest"), F.min(F.struct((-F.col("aim")).alias("o"), F.col(group).alias("g"))).alias("most"))  # one row
    aims = aims.crossJoin(F.broadcast(fix)).select(group, F.when(F.col(group) == F.col("most.g"), F.col("aim") + F.col("rest")).otherwise(F.col("aim")).alias("aim"))
    r = ranked(df, [group], hash_order(key, seed), 2 * n + 1).join(aims, group)
    # ranks above n can't be chosen unless other groups run out: n rows of any one group are enough to fill
    return r.orderBy(F.col("rank") > F.col("aim"), *hash_order(key, seed)).limit(n).select(key, group)


@CAT.query("smp_balanced_fill", withs("q1") + """, po AS (SELECT query_id, substr(domain, 1, 3) AS domain FROM q1), sz AS (SELECT domain, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM po))::BIGINT AS aim FROM po GROUP BY 1),
am AS (SELECT domain, aim + CASE WHEN row_number() OVER (ORDER BY aim DESC, domain) = 1 THEN 100 - sum(aim) OVER () ELSE 0 END AS aim FROM sz), rk AS (SELECT query_id, domain, row_number() OVER (PARTITION BY domain ORDER BY md5('42:' || query_id), query_id) > aim AS spare FROM po JOIN am USING (domain))
SELECT query_id, domain FROM rk ORDER BY spare, md5('42:' || query_id), query_id LIMIT 100""")
def _balanced(spark, d):
    return balanced(rel(spark, d, "q1").select("query_id", F.substring("domain", 1, 3).alias("domain")), "query_id", "domain", 100)


_AGREED = "SELECT clean_id(statement_id) AS query_id, clean_id(doc_id) AS doc_id, min(agreement) AS agreement FROM consensus_labels WHERE agreement IS NOT NULL AND statement_id IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1, 2"


def agreed(spark, d) -> DataFrame:
    c = table(spark, d, "consensus_labels").where("agreement is not null and statement_id is not null and doc_id is not null")
    return c.groupBy(clean_id("statement_id").alias("query_id"), clean_id("doc_id").alias("doc_id")).agg(F.min("agreement").alias("agreement"))


@CAT.query("smp_expert_100", f"WITH a AS ({_AGREED}) SELECT query_id, doc_id, agreement FROM a WHERE agreement NOT IN ('majority', 'unanimous') UNION ALL (SELECT * FROM a WHERE agreement = 'majority' ORDER BY md5('42:' || query_id || ' ' || doc_id), 1, 2 LIMIT 46) UNION ALL (SELECT * FROM a WHERE agreement = 'unanimous' ORDER BY md5('42:' || query_id || ' ' || doc_id), 1, 2 LIMIT 30)")
def _expert(spark, d):
    """All items without agreement, and 46 and 30 of those with a majority and with all votes alike."""
    a = agreed(spark, d).withColumn("item", F.concat_ws(" ", "query_id", "doc_id"))
    some = ranked(a.where("agreement in ('majority', 'unanimous')"), ["agreement"], hash_order("item", 42), 46).where("agreement = 'majority' or rank <= 30").drop("rank")
    return a.where("agreement not in ('majority', 'unanimous')").unionByName(some).select("query_id", "doc_id", "agreement")


@CAT.query("set_consensus_pairs", """WITH r AS (SELECT clean_id(statement_id) AS query_id, clean_id(doc_id) AS doc_id, provider, max(reasoning) AS t FROM relevance_judgments WHERE reasoning IS NOT NULL AND statement_id IS NOT NULL AND doc_id IS NOT NULL AND provider IN ('alder', 'brine', 'cobalt') GROUP BY 1, 2, 3),
w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(t), '\\s+'), lambda x: x <> '')) AS s FROM r), p AS (SELECT a.query_id, a.doc_id, a.t AS x, b.t AS y, a.provider || b.provider AS o, coalesce(len(list_intersect(a.s, b.s))::DOUBLE / nullif(len(list_distinct(list_concat(a.s, b.s))), 0), -1) AS j FROM w a JOIN w b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND a.provider < b.provider)
SELECT query_id, doc_id, CASE WHEN length(x) <= length(y) THEN x ELSE y END AS text, round(j, 6) AS jaccard FROM p QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY round(j, 9) DESC, o) = 1""")
def _pairs(spark, d):
    """Of the texts of three providers on an item, the shorter one of the pair most alike: three columns, so three comparisons in the row."""
    names = ("alder", "brine", "cobalt")
    r = table(spark, d, "relevance_judgments").where(F.col("reasoning").isNotNull() & F.col("statement_id").isNotNull() & F.col("doc_id").isNotNull() & F.col("provider").isin(*names))
    v = r.groupBy(clean_id("statement_id").alias("query_id"), clean_id("doc_id").alias("doc_id")).agg(*(F.max(F.when(F.col("provider") == n, F.col("reasoning"))).alias(n) for n in names))
    ws = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != ""))

    def pair(a: str, b: str) -> Column:
        j = F.coalesce(F.try_divide(F.size(F.array_intersect(ws(a), ws(b))).cast("double"), F.size(F.array_union(ws(a), ws(b))).cast("double")), F.lit(-1.0))
        text = F.when(F.length(a) <= F.length(b), F.col(a)).otherwise(F.col(b))
        return F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct((-F.round(j, 9)).alias("o"), F.lit(a + b).alias("p"), text.alias("text"), j.alias("j")))

    best = F.array_min(F.filter(F.array(pair("alder", "brine"), pair("alder", "cobalt"), pair("brine", "cobalt")), lambda x: x.isNotNull()))
    return v.withColumn("b", best).where("b is not null").select("query_id", "doc_id", "b.text", F.round("b.j", 6).alias("jaccard"))


@CAT.query("join_patent_corpus", r"""WITH q AS (SELECT split_part(clean_id(_id), '-', 1) AS patent_id, regexp_extract(clean_id(_id), '-C(\d+)$', 1)::INT AS n, coalesce(text, '') AS text FROM queries WHERE regexp_matches(clean_id(_id), '^US\d+-C\d+$')),
c AS (SELECT DISTINCT split_part(clean_id(statement_id), '-', 1) AS patent_id FROM consensus_labels) SELECT patent_id, text FROM q SEMI JOIN c USING (patent_id) QUALIFY row_number() OVER (PARTITION BY patent_id ORDER BY text = '' OR contains(lower(substr(text, 1, 50)), 'claim'), n, text) = 1""")
def _patent_corpus(spark, d):
    """Judged patents with their first independent claim: the first that doesn't name another claim at its head, else the first."""
    cited = table(spark, d, "consensus_labels").select(F.split_part(clean_id("statement_id"), F.lit("-"), F.lit(1)).alias("patent_id")).where("patent_id is not null")
    q = claims_of_queries(spark, d).withColumn("text", F.coalesce("text", F.lit("")))
    bound = (F.col("text") == "") | F.lower(F.substring("text", 1, 50)).contains("claim")
    first = q.groupBy("patent_id").agg(F.min(F.struct(bound.alias("o"), F.col("claim_number").alias("n"), "text")).alias("m"))
    return first.join(cited, "patent_id", "left_semi").select("patent_id", "m.text")


# --- novelty by elements --------------------------------------------------------------------

#: A document shows an element that has at least this share of its words in it (the stub of a model's answer).
SHOWN = 0.5


def elements(q: DataFrame) -> DataFrame:
    """(query_id, element, text) of claims cut at semicolons and commas; parts under ten characters are none."""
    return q.select("query_id", F.posexplode(F.split("text", r"[;,]\s*(?:and\s+)?")).alias("element", "t")).select("query_id", "element", F.trim("t").alias("text")).where("length(text) >= 10")


def disclosures(e: DataFrame, pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Cells (query_id, doc_id, element, confidence, shown) of elements against the documents to be read for the claim."""
    doc = pairs.select("query_id", "doc_id").join(docs.select("doc_id", F.array_distinct(words(F.concat_ws(" ", "title", "text"))).alias("w")), "doc_id")
    cells = e.select("query_id", "element", F.array_distinct(words("text")).alias("e")).join(doc, "query_id")
    share = F.coalesce(F.try_divide(F.size(F.array_intersect("e", "w")).cast("double"), F.size("e").cast("double")), F.lit(0.0))
    return cells.select("query_id", "doc_id", "element", share.alias("confidence"), (share >= SHOWN).alias("shown"))


_CELLS = withs("qrels", "q1", "corpus1") + r""", el AS (SELECT query_id, list_distinct(regexp_extract_all(lower(trim(t)), '[\p{L}\p{N}]+')) AS e FROM (SELECT query_id, unnest(regexp_split_to_array(text, '[;,]\s*(?:and\s+)?')) AS t FROM q1) WHERE length(trim(t)) >= 10),
dc AS (SELECT query_id, doc_id, list_distinct(regexp_extract_all(lower(concat_ws(' ', title, text)), '[\p{L}\p{N}]+')) AS w FROM qrels JOIN corpus1 USING (doc_id)),
cl AS (SELECT query_id, doc_id, coalesce(len(list_intersect(e, w))::DOUBLE / nullif(len(e), 0), 0) AS c FROM el JOIN dc USING (query_id)), mp AS (SELECT query_id, doc_id, count(*) AS n_elements, count(*) FILTER (WHERE c >= 0.5) AS n_shown, max(c) AS c FROM cl GROUP BY 1, 2) """


def _cells(spark, d) -> DataFrame:
    return disclosures(elements(rel(spark, d, "q1")), rel(spark, d, "qrels"), rel(spark, d, "corpus1"))


@CAT.query("nov_map", _CELLS + "SELECT query_id, doc_id, n_elements, n_shown, round(n_shown::DOUBLE / n_elements, 6) AS coverage, round(c, 6) AS confidence FROM mp")
def _map(spark, d):
    """Which share of a claim's elements each judged document shows, and the surest cell."""
    g = _cells(spark, d).groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("n_elements"), F.count_if("shown").alias("n_shown"), F.round(F.max("confidence"), 6).alias("confidence"))
    return g.withColumn("coverage", F.round(F.col("n_shown") / F.col("n_elements"), 6))


@CAT.query("nov_pipeline", _CELLS + ", el2 AS (SELECT query_id, max(n_shown::DOUBLE / n_elements) AS m, count(*) AS n_documents FROM mp GROUP BY 1) SELECT query_id, n_documents, round(m, 6) AS coverage, CASE WHEN m >= 0.95 THEN 'anticipated' WHEN m >= 0.8 THEN 'likely_anticipated' WHEN m >= 0.6 THEN 'likely_obvious' ELSE 'potentially_novel' END AS status, CASE WHEN m >= 0.9 THEN '102' ELSE '103' END AS rejection FROM el2")
def _novelty(spark, d):
    """Claim to status by its best covered reading: elements, documents, cells, consolidation as one plan."""
    per = _cells(spark, d).groupBy("query_id", "doc_id").agg((F.count_if("shown") / F.count(F.lit(1))).alias("c")).groupBy("query_id").agg(F.max("c").alias("m"), F.count(F.lit(1)).alias("n_documents"))
    m = F.col("m")
    status = F.when(m >= 0.95, "anticipated").when(m >= 0.8, "likely_anticipated").when(m >= 0.6, "likely_obvious").otherwise("potentially_novel")
    return per.select("query_id", "n_documents", F.round("m", 6).alias("coverage"), status.alias("status"), F.when(m >= 0.9, "102").otherwise("103").alias("rejection"))


@CAT.query("nov_parse", r"SELECT query_id, count(*) AS n_elements, sum(length(t))::BIGINT AS n_chars FROM (SELECT query_id, trim(unnest(regexp_split_to_array(text, '[;,]\s*(?:and\s+)?'))) AS t FROM (SELECT clean_id(_id) AS query_id, min(text) AS text FROM queries WHERE text IS NOT NULL AND _id IS NOT NULL GROUP BY 1)) WHERE length(t) >= 10 GROUP BY 1")
def _parse(spark, d):
    return elements(rel(spark, d, "q1")).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_elements"), F.sum(F.length("text")).alias("n_chars"))


# --- requests to a model, and its answers ---------------------------------------------------


@CAT.query("llm_tier2", withs("qrels", "q1", "corpus1") + "SELECT query_id, doc_id, md5(concat('CLAIM: ', q1.text, chr(10), chr(10), 'DOCUMENT: ', coalesce(title, ''), chr(10), substr(coalesce(c.text, ''), 1, 2000))) AS request FROM qrels JOIN q1 USING (query_id) JOIN corpus1 c USING (doc_id)")
def _pair_request(spark, d):
    """The request that has a pair graded; a model sees as much of the document as its window is given."""
    p = rel(spark, d, "qrels").join(rel(spark, d, "q1").select("query_id", F.col("text").alias("claim")), "query_id").join(rel(spark, d, "corpus1").select("doc_id", "title", "text"), "doc_id")
    request = F.concat(F.lit("CLAIM: "), "claim", F.lit("\n\nDOCUMENT: "), F.coalesce("title", F.lit("")), F.lit("\n"), F.substring(F.coalesce("text", F.lit("")), 1, 2000))
    return p.select("query_id", "doc_id", F.md5(request).alias("request"))


@CAT.query("llm_tier3", withs("qrels", "corpus1") + ", r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS k FROM qrels JOIN corpus1 USING (doc_id)) SELECT query_id, count(*) AS n_documents, md5(string_agg('[' || k || '] ' || coalesce(title, '') || ': ' || substr(coalesce(text, ''), 1, 300), chr(10) ORDER BY k)) AS context FROM r JOIN corpus1 USING (doc_id) WHERE k <= 10 GROUP BY 1")
def _context_request(spark, d):
    """The ten best documents of a statement as context, 300 characters each. Ten rows per group at most reach the list."""
    j = rel(spark, d, "qrels").join(rel(spark, d, "corpus1").select("doc_id", "title", F.substring(F.coalesce("text", F.lit("")), 1, 300).alias("t")), "doc_id")
    top = ranked(j, ["query_id"], [F.desc("relevance"), F.asc("doc_id")], 10)
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit(": "), F.col("t"))
    g = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_documents"), F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("v"))
    return g.select("query_id", "n_documents", F.md5(F.array_join(F.transform("v", lambda x: x["line"]), "\n")).alias("context"))


@CAT.query("llm_annotate", """WITH v AS (SELECT clean_id(statement_id) AS query_id, clean_id(doc_id) AS doc_id, provider, greatest(0, least(3, max(relevance_score))) AS s FROM relevance_judgments WHERE relevance_score IS NOT NULL AND statement_id IS NOT NULL AND doc_id IS NOT NULL AND provider IS NOT NULL GROUP BY 1, 2, 3),
n AS (SELECT query_id, doc_id, count(*) AS n_votes, mode(s ORDER BY s) AS m0 FROM v GROUP BY 1, 2 HAVING count(*) >= 2), c AS (SELECT query_id, doc_id, s, count(*) AS k FROM v GROUP BY 1, 2, 3), w AS (SELECT query_id, doc_id, s, k FROM c QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY k DESC, s) = 1),
x AS (SELECT clean_id(statement_id) AS query_id, clean_id(doc_id) AS doc_id, max(consensus_score) AS ex FROM consensus_labels WHERE consensus_score BETWEEN 0 AND 3 AND statement_id IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1, 2)
SELECT query_id, doc_id, n_votes, s::INT AS score, (s > 0) = (ex > 0) AS examiner_agrees FROM n JOIN w USING (query_id, doc_id) LEFT JOIN x USING (query_id, doc_id)""")
def _annotate(spark, d):
    """Votes clamped to the grades, items with two votes and more, the commonest (lesser) grade, and whether the examiner's sign agrees."""
    r = table(spark, d, "relevance_judgments").where("relevance_score is not null and statement_id is not null and doc_id is not null and provider is not null")
    v = r.groupBy(clean_id("statement_id").alias("query_id"), clean_id("doc_id").alias("doc_id"), "provider").agg(F.greatest(F.lit(0), F.least(F.lit(3), F.max("relevance_score"))).alias("s"))
    n = v.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("n_votes"), *(F.count_if(F.col("s") == k).alias(f"n{k}") for k in range(4))).where("n_votes >= 2")
    best = F.array_min(F.array(*(F.struct((-F.col(f"n{k}")).alias("o"), F.lit(k).alias("g")) for k in range(4))))["g"]
    x = rel(spark, d, "qrels")
    return n.join(x, ["query_id", "doc_id"], "left").select("query_id", "doc_id", "n_votes", best.alias("score"), ((best > 0) == (F.col("relevance") > 0)).alias("examiner_agrees"))


@CAT.query("llm_curate", withs("qrels", "q1") + "SELECT query_id, count(doc_id) FILTER (WHERE relevance > 0) AS n_relevant, CASE WHEN count(doc_id) FILTER (WHERE relevance > 0) >= 3 THEN 'ANTICIPATED' WHEN count(doc_id) FILTER (WHERE relevance > 0) >= 1 THEN 'PARTIALLY_ANTICIPATED' ELSE 'NOVEL' END AS label FROM q1 LEFT JOIN qrels USING (query_id) GROUP BY 1")
def _curate(spark, d):
    """Label of a statement from its number of relevant documents."""
    n = rel(spark, d, "q1").select("query_id").join(rel(spark, d, "qrels").where("relevance > 0"), "query_id", "left").groupBy("query_id").agg(F.count("doc_id").alias("n_relevant"))
    return n.withColumn("label", F.when(F.col("n_relevant") >= 3, "ANTICIPATED").when(F.col("n_relevant") >= 1, "PARTIALLY_ANTICIPATED").otherwise("NOVEL"))
