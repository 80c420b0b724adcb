"""Round trips through the file formats as queries: what is written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.text import clean_id
from ..plans.catalog import Catalogue, rel, withs
from ..plans.shared import shared_dir
from ..sources import files
from ..sources.tables import table

CAT = Catalogue()
queries, oracle_sql = CAT.queries, CAT.oracle_sql


def _place(spark, name: str) -> str:
    """A new folder in the shared place."""
    return f"{shared_dir(spark)}/plumbline-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


@CAT.query("src_corpus_jsonl", withs("corpus1") + "SELECT doc_id AS _id, coalesce(title, '') AS title, length(coalesce(text, ''))::INT AS n_chars, doc_type FROM corpus1")
def _corpus(spark, d):
    p = _place(spark, "corpus")
    files.write_corpus(rel(spark, d, "corpus1").withColumnRenamed("doc_id", "_id"), p)
    return files.read_corpus(spark, p).select("_id", "title", F.length("text").alias("n_chars"), "doc_type")


@CAT.query("src_queries_jsonl", withs("q1") + "SELECT query_id AS _id, text FROM q1")
def _queries(spark, d):
    p = _place(spark, "queries")
    files.write_queries(rel(spark, d, "q1").withColumnRenamed("query_id", "_id"), p)
    return files.read_queries(spark, p)


@CAT.query("src_qrels_tsv", withs("qrels") + "SELECT query_id, doc_id, max(relevance) AS relevance FROM (SELECT replace(query_id, chr(9), '') AS query_id, replace(doc_id, chr(9), '') AS doc_id, relevance FROM qrels) WHERE query_id IN (SELECT clean_id(_id) FROM queries WHERE split = 'test') GROUP BY 1, 2")
def _qrels(spark, d):
    p = _place(spark, "qrels")
    s = table(spark, d, "queries").where("split is not null").groupBy(clean_id("_id").alias("query_id")).agg(F.max_by("split", F.col("split") == "test").alias("split"))
    ids = [F.translate(c, "\t", "").alias(c) for c in ("query_id", "doc_id")]
    q = rel(spark, d, "qrels").select(*ids, "relevance").groupBy("query_id", "doc_id").agg(F.max("relevance").alias("relevance"))
    files.write_qrels(q.join(s, "query_id"), p)
    return files.read_qrels(spark, f"{p}/split=test")


@CAT.query("snk_trec_run", withs("scored") + "SELECT printf('%s Q0 %s %d %.6f %s', query_id, doc_id, rank, score, 'alder') AS line FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored WHERE system = 'alder')")
def _trec(spark, d):
    p = _place(spark, "trec")
    files.write_trec(rel(spark, d, "scored").where("system = 'alder'"), p, "alder")
    return spark.read.text(p).select(F.col("value").alias("line"))


@CAT.query("src_parquet", withs("links") + "SELECT source, confidence, count(*) AS n FROM links GROUP BY 1, 2")
def _parquet(spark, d):
    p = _place(spark, "links")
    rel(spark, d, "links").write.partitionBy("source").parquet(p)
    return spark.read.parquet(p).groupBy("source", "confidence").agg(F.count(F.lit(1)).alias("n"))


@CAT.query("src_splits_manifest", "SELECT split, count(*) AS n, count(DISTINCT clean_id(_id)) AS n_ids FROM queries WHERE split IS NOT NULL GROUP BY 1")
def _splits(spark, d):
    """Splits as folders with a manifest in JSON that names them and their rows; they are read by the manifest."""
    p = _place(spark, "splits")
    q = table(spark, d, "queries").where("split is not null").select("split", clean_id("_id").alias("id"))
    q.write.partitionBy("split").parquet(f"{p}/data")
    q.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.concat(F.lit("split="), F.first("split")).alias("folder")).write.json(f"{p}/manifest")
    manifest = spark.read.schema("split string, n bigint, folder string").json(f"{p}/manifest")
    ids = spark.read.parquet(f"{p}/data").groupBy("split").agg(F.count_distinct("id").alias("n_ids"))
    return manifest.join(ids, "split").select("split", "n", "n_ids")


@CAT.query("src_ros_csv", withs("links") + "SELECT paper_id AS openalex_id, patent_id, confidence FROM links WHERE confidence >= 8 AND length(patent_id) <= 7")
def _ros(spark, d):
    p = _place(spark, "ros")
    l = rel(spark, d, "links").where("length(patent_id) <= 7")
    l.select(F.col("paper_id").alias("oaid"), F.concat(F.lit("us-"), "patent_id", F.lit("-b2")).alias("patent"), F.col("confidence").alias("confscore"), F.col("source").alias("wherefound"), F.lit("npl").alias("reftype")).write.option("header", True).csv(p)
    return files.read_citation_csv(spark, p).select("openalex_id", "patent_id", "confidence")


@CAT.query("src_fasta", "SELECT DISTINCT inchi_key AS id, regexp_replace(upper(smiles), '[^A-Z]', '', 'g') AS sequence, CASE WHEN regexp_matches(regexp_replace(upper(smiles), '[^A-Z]', '', 'g'), '^[ACGTUN-]+$') THEN 'NT' ELSE 'AA' END AS kind FROM chemical_hits WHERE inchi_key IS NOT NULL AND regexp_matches(smiles, '[A-Za-z]')")
def _fasta(spark, d):
    p = _place(spark, "fasta")
    s = table(spark, d, "chemical_hits").where("inchi_key is not null and smiles rlike '[A-Za-z]'").select(F.col("inchi_key").alias("id"), F.regexp_replace(F.upper("smiles"), "[^A-Z]", "").alias("sequence")).distinct()
    files.write_fasta(s.select("id", F.lit("patent").alias("source_type"), F.lit("US1").alias("source_id"), F.lit("made of letters").alias("description"), "sequence"), p)
    return files.read_fasta(spark, p).select("id", "sequence", "kind")


@CAT.query("src_qrels_tsv_hdr", withs("qrels") + "SELECT replace(query_id, chr(9), '') AS query_id, max(relevance) AS best, count(*) AS n FROM (SELECT DISTINCT replace(query_id, chr(9), '') AS query_id, replace(doc_id, chr(9), '') AS doc_id, max(relevance) AS relevance FROM qrels GROUP BY 1, 2) GROUP BY 1")
def _header(spark, d):
    p = _place(spark, "headed")
    ids = [F.translate(c, "\t", "").alias(c) for c in ("query_id", "doc_id")]
    q = rel(spark, d, "qrels").select(*ids, "relevance").groupBy("query_id", "doc_id").agg(F.max("relevance").alias("relevance"))
    q.select("query_id", "doc_id", F.col("relevance").cast("string").alias("relevance")).write.option("sep", "\t").option("header", True).csv(p)
    return files.read_qrels(spark, p).groupBy("query_id").agg(F.max("relevance").alias("best"), F.count(F.lit(1)).alias("n"))

@CAT.query("snk_beir_corpus", withs("papers1", "corpus1") + "SELECT _id, doc_type, title, n_chars, date FROM (SELECT 'paper_' || paper_id AS _id, 'paper' AS doc_type, coalesce(title, '') AS title, length(coalesce(abstract, ''))::INT AS n_chars, publication_date AS date FROM papers1 UNION ALL SELECT 'patent_' || doc_id, coalesce(doc_type, 'patent'), coalesce(title, ''), length(coalesce(text, ''))::INT, date FROM corpus1)")
def _beir_corpus(spark, d):
    """Papers and corpus documents as one collection of JSON lines with type and date, read again."""
    p = _place(spark, "beir-corpus")
    papers = rel(spark, d, "papers1").select(F.concat(F.lit("paper_"), "paper_id").alias("_id"), "title", F.col("abstract").alias("text"), F.lit("paper").alias("doc_type"), F.col("publication_date").alias("date"))
    docs = rel(spark, d, "corpus1").select(F.concat(F.lit("patent_"), "doc_id").alias("_id"), "title", "text", F.coalesce("doc_type", F.lit("patent")).alias("doc_type"), "date")
    files.write_corpus(papers.unionByName(docs), p)
    return files.read_corpus(spark, p).select("_id", "doc_type", "title", F.length("text").alias("n_chars"), "date")


@CAT.query("snk_beir_queries", withs("q1") + "SELECT query_id AS _id, text, domain FROM q1")
def _beir_queries(spark, d):
    """Queries as JSON lines with a column of metadata."""
    p = _place(spark, "beir-queries")
    rel(spark, d, "q1").select(F.col("query_id").alias("_id"), "text", F.struct("domain").alias("metadata")).write.json(p)
    q = spark.read.schema("_id string, text string, metadata struct<domain: string>").json(p)
    return q.select("_id", "text", "metadata.domain")


_SPLITS = ", s AS (SELECT clean_id(_id) AS query_id, min(split) AS split FROM queries WHERE split IS NOT NULL AND _id IS NOT NULL GROUP BY 1)"


def _split_of(spark, d):
    return table(spark, d, "queries").where("split is not null and _id is not null").groupBy(clean_id("_id").alias("query_id")).agg(F.min("split").alias("split"))


@CAT.query("snk_beir_qrels", withs("qrels") + _SPLITS + " SELECT split, query_id, doc_id, relevance FROM qrels JOIN s USING (query_id)")
def _beir_qrels(spark, d):
    """A TSV folder per split; the split is read back from the folder's name."""
    p = _place(spark, "beir-qrels")
    files.write_qrels(rel(spark, d, "qrels").join(_split_of(spark, d), "query_id"), p)
    q = spark.read.option("sep", "\t").schema("query_id string, doc_id string, relevance int, split string").csv(p)
    return q.select("split", "query_id", "doc_id", "relevance")


@CAT.query("snk_beir_validate", withs("corpus1", "qrels") + ", p AS (SELECT count(*) AS n_judgments, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM corpus1)) AS n_unknown FROM qrels) SELECT coalesce(doc_type, '') AS doc_type, count(*) AS n, count(*) FILTER (WHERE coalesce(text, '') = '') AS n_without_text, 0::BIGINT AS n_broken, any_value(n_judgments) AS n_judgments, any_value(n_unknown) AS n_unknown FROM corpus1, p GROUP BY 1")
def _validate(spark, d):
    """What was written, read as text and checked: lines that aren't JSON, documents per type and without text, judgments of unknown documents."""
    p = _place(spark, "validated")
    files.write_corpus(rel(spark, d, "corpus1").withColumnRenamed("doc_id", "_id"), p)
    c = spark.read.text(p).select(F.from_json("value", files.CORPUS).alias("c"), F.get_json_object("value", "$._id").isNull().alias("broken")).select("c.*", "broken")
    q = rel(spark, d, "qrels").join(c.select(F.col("_id").alias("doc_id"), F.lit(True).alias("known")), "doc_id", "left").agg(F.count(F.lit(1)).alias("n_judgments"), F.count_if(F.col("known").isNull()).alias("n_unknown"))  # one row
    g = c.groupBy(F.coalesce("doc_type", F.lit("")).alias("doc_type")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("n_without_text"), F.count_if("broken").alias("n_broken"))
    return g.crossJoin(F.broadcast(q))


@CAT.query("snk_statement_beir", withs("qrels", "q1") + "SELECT 'tier1' AS tier, query_id, doc_id, relevance FROM qrels WHERE relevance >= 1 UNION ALL SELECT 'tier2', query_id, doc_id, relevance FROM qrels UNION ALL SELECT 'tier3', query_id, query_id, (CASE WHEN m >= 3 THEN 2 WHEN m >= 1 THEN 1 ELSE 0 END)::INT FROM (SELECT query_id, max(relevance) AS m FROM qrels GROUP BY 1)")
def _statement_beir(spark, d):
    """Judgments of the three tiers as headed TSV, each sorted by query and document, and read again."""
    p = _place(spark, "tiers")
    q = rel(spark, d, "qrels")
    label = F.when(F.col("m") >= 3, 2).when(F.col("m") >= 1, 1).otherwise(0)
    tiers = {"tier1": q.where("relevance >= 1"), "tier2": q, "tier3": q.groupBy("query_id").agg(F.max("relevance").alias("m")).select("query_id", F.col("query_id").alias("doc_id"), label.alias("relevance"))}
    out = None
    for name, df in tiers.items():
        df.select("query_id", "doc_id", "relevance").orderBy("query_id", "doc_id").write.option("sep", "\t").option("header", True).csv(f"{p}/{name}")
        back = spark.read.option("sep", "\t").option("header", True).schema("query_id string, doc_id string, relevance int").csv(f"{p}/{name}").select(F.lit(name).alias("tier"), "*")
        out = back if out is None else out.unionByName(back)
    return out


STATEMENT = "statement_id string, text string, domain string, ground_truth struct<tier1_relevant_docs: array<string>, tier3_novelty_label: string>"


@CAT.query("src_statements", withs("qrels", "q1") + ", g AS (SELECT query_id, count(*) FILTER (WHERE relevance > 0) AS n, max(relevance) AS m FROM q1 LEFT JOIN qrels USING (query_id) GROUP BY 1) SELECT query_id AS statement_id, domain, doc_id, 1 AS tier1, 1 AS tier2, (CASE WHEN m = 3 THEN 2 WHEN m > 0 THEN 1 ELSE 0 END)::INT AS tier3 FROM g JOIN q1 USING (query_id) LEFT JOIN (SELECT query_id, doc_id FROM qrels WHERE relevance > 0) USING (query_id)")
def _statements(spark, d):
    """Statements with their ground truth nested. Where no judgments were delivered apart, the first tier is
    the listed documents at grade 1, the second tier that of grade 1 and more, the third the label's number.
    Long lists are cut into several lines of a statement."""
    from .records import answers

    p = _place(spark, "statements")
    q = rel(spark, d, "qrels").where("relevance > 0")
    label = F.when(F.col("m") == 3, "ANTICIPATED").when(F.col("m") > 0, "PARTIALLY_ANTICIPATED").otherwise("NOVEL")
    best = q.groupBy("query_id").agg(F.max("relevance").alias("m"))
    docs = answers(q.select("query_id", "doc_id"), "query_id", "doc_id").groupBy("query_id", "part").agg(F.collect_list("doc_id").alias("docs"))
    s = rel(spark, d, "q1").join(best, "query_id", "left").join(docs, "query_id", "left")
    s.select(F.col("query_id").alias("statement_id"), "text", "domain", F.struct(F.col("docs").alias("tier1_relevant_docs"), label.alias("tier3_novelty_label")).alias("ground_truth")).write.json(p)
    number = F.create_map(*(F.lit(x) for kv in (("NOVEL", 0), ("PARTIALLY_ANTICIPATED", 1), ("ANTICIPATED", 2)) for x in kv))
    r = spark.read.schema(STATEMENT).json(p)
    return r.select("statement_id", "domain", F.explode_outer("ground_truth.tier1_relevant_docs").alias("doc_id"), F.lit(1).alias("tier1"), F.lit(1).alias("tier2"), F.coalesce(F.try_element_at(number, F.col("ground_truth.tier3_novelty_label")), F.lit(0)).alias("tier3"))


@CAT.query("src_beir_load", withs("corpus1", "q1", "qrels") + "SELECT (SELECT count(*) FROM corpus1) AS n_documents, (SELECT count(*) FROM q1) AS n_queries, count(*) AS n_judgments, count(*) FILTER (WHERE query_id IN (SELECT query_id FROM q1) AND doc_id IN (SELECT doc_id FROM corpus1)) AS n_complete FROM qrels")
def _load(spark, d):
    """A whole benchmark folder: collection, queries and judgments as three tables, and how many judgments have both sides."""
    p = _place(spark, "benchmark")
    files.write_corpus(rel(spark, d, "corpus1").withColumnRenamed("doc_id", "_id"), f"{p}/corpus")
    files.write_queries(rel(spark, d, "q1").withColumnRenamed("query_id", "_id"), f"{p}/queries")
    files.write_qrels(rel(spark, d, "qrels").withColumn("split", F.lit("all")), f"{p}/qrels")
    c, q, j = files.read_benchmark(spark, p)
    both = j.join(q.select(F.col("_id").alias("query_id"), F.lit(1).alias("a")), "query_id", "left").join(c.select(F.col("_id").alias("doc_id"), F.lit(1).alias("b")), "doc_id", "left")
    n = both.agg(F.count(F.lit(1)).alias("n_judgments"), F.count(F.col("a") + F.col("b")).alias("n_complete"))
    return c.agg(F.count(F.lit(1)).alias("n_documents")).crossJoin(q.agg(F.count(F.lit(1)).alias("n_queries"))).crossJoin(n)  # a row each


@CAT.query("src_preds_jsonl", withs("judged") + "SELECT query_id, max(score)::VARCHAR AS label FROM judged GROUP BY 1")
def _predictions(spark, d):
    """Predictions in JSON lines, with lines that are broken, not ok or without a label among them."""
    p = _place(spark, "predictions")
    g = rel(spark, d, "judged").groupBy("query_id").agg(F.max("score").cast("string").alias("label"))
    good = g.select(F.to_json(F.struct("query_id", "label", F.lit(True).alias("ok"))).alias("value"))
    bad = g.select(F.explode(F.array(F.to_json(F.struct("query_id", F.lit("9").alias("label"), F.lit(False).alias("ok"))), F.to_json(F.struct("query_id", F.lit(True).alias("ok"))), F.lit('{"query_id": '))).alias("value"))
    good.unionByName(bad).write.text(p)
    return files.read_predictions(spark, p)


@CAT.query("rep_checksum", "SELECT 'ok' AS state, 3::BIGINT AS n_files")
def _checksums(spark, d):
    """Checksums of written files kept as a manifest, and the files held against it."""
    p = _place(spark, "checked")
    rel(spark, d, "q_domain").repartition(3).write.json(f"{p}/data")
    files.checksums(spark, f"{p}/data").write.json(f"{p}/manifest")
    return files.verified(spark, f"{p}/data", f"{p}/manifest").groupBy("state").agg(F.count(F.lit(1)).alias("n_files"))


@CAT.query("snk_metadata", "SELECT count(*) AS n_rows, count(DISTINCT paper_id) AS n_papers, count(DISTINCT journal) AS n_journals, strftime(min(parse_day(publication_date)), '%Y-%m-%d') AS first_day, strftime(max(parse_day(publication_date)), '%Y-%m-%d') AS last_day, count(abstract) AS n_abstracts, 4::BIGINT AS n_files FROM papers")
def _metadata(spark, d):
    """Counts and span of what was written, with the number of files that have a checksum."""
    p = _place(spark, "described")
    table(spark, d, "papers").select("paper_id", "journal", "publication_date", "abstract").repartition(4, "paper_id").write.parquet(p)
    w = spark.read.parquet(p)
    day = parse_date(F.col("publication_date"))
    m = w.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("paper_id").alias("n_papers"), F.count_distinct("journal").alias("n_journals"), F.date_format(F.min(day), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max(day), "yyyy-MM-dd").alias("last_day"), F.count("abstract").alias("n_abstracts"))
    return m.crossJoin(files.checksums(spark, p).where("sha256 is not null and file like '%.parquet'").agg(F.count(F.lit(1)).alias("n_files")))


@CAT.query("snk_json_ckpt", withs("qrels") + "SELECT relevance, count(*) AS n FROM qrels GROUP BY 1")
def _checkpoint(spark, d):
    """A step's result kept by name: the second call reads what the first has written."""
    p = _place(spark, "steps")
    step = lambda: rel(spark, d, "qrels").groupBy("relevance").agg(F.count(F.lit(1)).alias("n"))
    files.kept_step(spark, p, "relevance", step)
    return files.kept_step(spark, p, "relevance", lambda: step().limit(0))


@CAT.query("snk_index", r"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def _index(spark, d):
    """Postings kept as a table partitioned by a hash of the term, and read again."""
    from ..operators.retrieval import postings

    p = _place(spark, "postings")
    i = postings(table(spark, d, "documents").select("doc_id", "text"))
    i.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(16))).repartition(16, "part").write.partitionBy("part").parquet(p)
    return spark.read.parquet(p).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
