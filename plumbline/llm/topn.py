"""The N best items of every group, by a mergeable bounded heap.

Before the shuffle each task keeps a heap of at most N distinct items per group
and emits it; only heaps are shuffled, then merged. An item that a partial heap
drops has N better distinct items in that very partition, so it can't be among
the N best overall: the aggregation is exact. Order: score descending, then the
unique id ascending by code points.

A task holds at most ``STATE_ROWS`` heap rows: beyond that it emits its heaps
and begins anew, so millions of groups don't exhaust it, and a group of any
size leaves at most N rows per emission.

Defined cases: rows with a null group or id, or a null or NaN score, don't
count; a repeated item counts once with its highest score; groups with fewer
than N items give all of them; an empty table gives no rows; other columns of
the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table

#: Heap rows that a task holds before it emits them.
STATE_ROWS = 400_000
#: Rows gathered between two reductions of the heaps.
STEP_ROWS = 100_000


def _reduce(t: pa.Table, groups: list[str], n: int) -> pa.Table:
    """At most n best distinct ids per group."""
    t = t.group_by([*groups, "id"], use_threads=False).aggregate([("score", "max")]).rename_columns([*groups, "id", "score"])
    t = t.take(pc.sort_indices(t, sort_keys=[*((g, "ascending") for g in groups), ("score", "descending"), ("id", "ascending")])).combine_chunks()
    if t.num_rows < 2:
        return t
    new = np.zeros(t.num_rows, dtype=bool)
    new[0] = True
    for g in groups:
        c = t[g]
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, t.num_rows - 1)).to_numpy(zero_copy_only=False)
    start = np.maximum.accumulate(np.where(new, np.arange(t.num_rows), 0))
    return t.filter(pa.array(np.arange(t.num_rows) - start < n))


def _heaps(groups: list[str], n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []
        rows = held = 0
        for b in batches:
            kept.append(pa.Table.from_batches([b]))
            rows += b.num_rows
            if rows - held < STEP_ROWS:
                continue
            state = _reduce(pa.concat_tables(kept), groups, n)
            kept, rows, held = [state], state.num_rows, state.num_rows
            if held > STATE_ROWS:
                yield from state.to_batches(max_chunksize=50_000)
                kept, rows, held = [], 0, 0
        if kept:
            yield from _reduce(pa.concat_tables(kept), groups, n).to_batches(max_chunksize=50_000)

    return run


def top_n(df: DataFrame, groups: list[str], id_col: str, score: str | Column, n: int) -> DataFrame:
    """(groups..., id, score, rank): the n best distinct ids of each group."""
    s = F.col(score) if isinstance(score, str) else score
    keys = [f"g{i}" for i in range(len(groups))]
    slim = df.select(*(F.col(g).cast("string").alias(k) for g, k in zip(groups, keys)), F.col(id_col).cast("string").alias("id"), (s.cast("double") + F.lit(0.0)).alias("score"))
    slim = slim.where(" and ".join(f"{k} is not null" for k in [*keys, "id", "score"]) + " and not isnan(score)")
    schema = ", ".join(f"{k} string" for k in [*keys, "id"]) + ", score double"
    heaps = slim.mapInArrow(_heaps(keys, n), schema).repartition(*keys)
    merged = heaps.groupBy(*keys, "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("id")))
    return merged.withColumn("rank", rank).where(F.col("rank") <= n).select(*(F.col(k).alias(g) for k, g in zip(keys, groups)), "id", "score", "rank")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    blast = table(spark, sf_dir, "blast_hits").select(F.lit("blast").alias("search"), "query_id", F.col("subject_id").alias("hit_id"), F.col("bit_score").alias("score")).where("score >= 0")
    chem = table(spark, sf_dir, "chemical_hits").select(F.lit("chemical").alias("search"), "query_id", F.col("chemical_id").alias("hit_id"), F.col("similarity").alias("score")).where("score >= 0 and score <= 1")
    return blast.unionByName(chem)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best hits of every query of both searches."""
    return top_n(_hits(spark, sf_dir), ["search", "query_id"], "hit_id", "score", 10).select("search", "query_id", F.col("id").alias("hit_id"))


def p6_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best hits with score and rank."""
    return top_n(_hits(spark, sf_dir), ["search", "query_id"], "hit_id", "score", 10).select("search", "query_id", F.col("id").alias("hit_id"), "score", F.col("rank").cast("int").alias("rank"))


def queries():
    return {"p6_found": p6_found, "p6_ranked": p6_ranked}


_SQL = """WITH h AS (
  SELECT 'blast' AS search, query_id, subject_id AS hit_id, bit_score AS score FROM blast_hits WHERE bit_score >= 0 AND NOT isnan(bit_score)
  UNION ALL
  SELECT 'chemical', query_id, chemical_id, similarity FROM chemical_hits WHERE similarity >= 0 AND similarity <= 1 AND NOT isnan(similarity)),
one AS (SELECT search, query_id, hit_id, max(score) AS score FROM h WHERE query_id IS NOT NULL AND hit_id IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY search, query_id ORDER BY score DESC, hit_id COLLATE "C" ASC) AS rank FROM one)
"""


def oracle_sql():
    sql = _SQL.replace(' COLLATE "C"', "")
    return {
        "p6_found": sql + "SELECT search, query_id, hit_id FROM r WHERE rank <= 10",
        "p6_ranked": sql + "SELECT search, query_id, hit_id, score, rank::INT AS rank FROM r WHERE rank <= 10",
    }
