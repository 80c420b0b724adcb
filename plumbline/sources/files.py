"""Text formats of retrieval benchmarks, with explicit schemas: no inference pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import patent

CORPUS = "_id string, title string, text string, doc_type string, date string"
QUERIES = "_id string, text string"
LINKS = "oaid string, patent string, confscore int, wherefound string, reftype string"


def read_citation_csv(spark: SparkSession, path: str, threshold: int = 8, examiner_only: bool = False) -> DataFrame:
    """Citation links of a CSV with header: ids normalised, confidence at or above the threshold."""
    d = spark.read.schema(LINKS).option("header", True).csv(path)
    d = d.select(F.col("oaid").alias("openalex_id"), patent(F.regexp_replace("patent", r"(?i)-?[A-Z]\d?$", ""))["number"].alias("patent_id"), F.col("confscore").alias("confidence"), F.col("wherefound").alias("examiner_applicant"), F.col("reftype").alias("ref_type"))
    d = d.where(F.col("confidence") >= threshold)
    return d.where(F.lower("examiner_applicant").rlike("examiner|front|both")) if examiner_only else d


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of documents; missing fields are empty."""
    return spark.read.schema(CORPUS).json(path).na.fill("", ["title", "text"])


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUERIES).json(path).na.fill("", ["text"])


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Judgments of a TSV with or without header and blank lines; of repeated pairs the last
    line of a file wins."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("n"))
    p = lines.where("trim(value) <> '' and not startswith(value, 'query_id')").select(F.split("value", "\t").alias("x"), "f", "n").where("size(x) >= 3")
    rows = p.select(F.get("x", F.lit(0)).alias("query_id"), F.get("x", F.lit(1)).alias("doc_id"), F.get("x", F.lit(2)).try_cast("int").alias("relevance"), "n").where("relevance is not null")
    return rows.groupBy("query_id", "doc_id").agg(F.max_by("relevance", "n").alias("relevance"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions of JSON lines; broken lines and those without a label are left out, the last per query wins."""
    d = spark.read.schema("query_id string, label string, ok boolean, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    d = d.withColumn("n", F.monotonically_increasing_id()).where("_bad is null and ok and label is not null")
    return d.groupBy("query_id").agg(F.max_by("label", "n").alias("label"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, source_type, source_id, description, sequence, kind) of records ``>id|type:source|text``."""
    r = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    head, body = F.split_part("value", F.lit("\n"), F.lit(1)), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*", ""), r"\s+", "")
    f = F.split(head, r"\|")
    seq = F.upper(body)
    return r.select(
        F.trim(F.get(f, F.lit(0))).alias("id"),
        F.split_part(F.coalesce(F.get(f, F.lit(1)), F.lit("")), F.lit(":"), F.lit(1)).alias("source_type"),
        F.split_part(F.coalesce(F.get(f, F.lit(1)), F.lit("")), F.lit(":"), F.lit(2)).alias("source_id"),
        F.coalesce(F.trim(F.get(f, F.lit(2))), F.lit("")).alias("description"),
        seq.alias("sequence"),
        F.when(seq.rlike("^[ACGTUN-]+$"), "NT").otherwise("AA").alias("kind"),
    )


def write_fasta(df: DataFrame, path: str, width: int = 80) -> None:
    """Records with the sequence wrapped."""
    body = F.regexp_replace("sequence", f"(.{{{width}}})(?!$)", "$1\n")
    df.select(F.concat(F.lit(">"), F.concat_ws("|", "id", F.concat_ws(":", "source_type", "source_id"), "description"), F.lit("\n"), body).alias("value")).write.mode("overwrite").text(path)


def write_corpus(df: DataFrame, path: str) -> None:
    df.select("_id", "title", "text", "doc_type", "date").write.mode("overwrite").json(path)


def write_queries(df: DataFrame, path: str) -> None:
    df.select("_id", "text").write.mode("overwrite").json(path)


def write_qrels(df: DataFrame, path: str) -> None:
    """One folder of TSV per split; a split without rows makes none."""
    df.select("split", "query_id", "doc_id", F.col("relevance").cast("string")).write.mode("overwrite").partitionBy("split").option("sep", "\t").csv(path)


def trec_lines(run: DataFrame, name: str, k: int = 1000) -> DataFrame:
    """(value): ``query Q0 document rank score name`` of the k best per query."""
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("doc_id").asc()))
    return run.withColumn("rank", r).where(F.col("rank") <= k).select(F.format_string("%s Q0 %s %d %.6f %s", "query_id", "doc_id", "rank", "score", F.lit(name)).alias("value"))


def write_trec(run: DataFrame, path: str, name: str, k: int = 1000) -> None:
    trec_lines(run, name, k).write.mode("overwrite").text(path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of the files below a folder, computed where they are read."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return b.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verified(spark: SparkSession, path: str, manifest: str) -> DataFrame:
    """(file, state) of the files in a manifest of :func:`checksums` and below the folder: ok, changed, missing or new."""
    old = spark.read.schema("file string, bytes bigint, sha256 string").json(manifest).select("file", F.col("sha256").alias("was"))
    j = old.join(checksums(spark, path).select("file", F.col("sha256").alias("now")), "file", "full")
    return j.select("file", F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "missing").when(F.col("was") == F.col("now"), "ok").otherwise("changed").alias("state"))


def read_benchmark(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, qrels) of a folder; the judgments of all splits together."""
    return read_corpus(spark, f"{path}/corpus"), read_queries(spark, f"{path}/queries"), read_qrels(spark, f"{path}/qrels")


def kept_step(spark: SparkSession, path: str, name: str, step) -> DataFrame:
    """The result of a step as JSON lines with its schema, made once: a finished folder is read instead."""
    target = f"{path}/{name}"
    sc = spark.sparkContext
    done = sc._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
    if not done.getFileSystem(sc._jsc.hadoopConfiguration()).exists(done):
        step().write.mode("overwrite").json(target)
    return spark.read.schema(step().schema).json(target)
