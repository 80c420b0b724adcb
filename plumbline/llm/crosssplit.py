"""The same or nearly the same records in different splits.

Texts become bags of words; a shingle here is one word with its occurrence
number, because the project states the overlap in shared words, in any order.
Each distinct bag gets ``BANDS * ROWS`` minwise hashes, bands of ``ROWS`` make
buckets, and only buckets with classes of both splits give candidates, as
stars that are completed across the splits. Each pair is verified exactly by
the size of the intersection of the bags. Shared words of 0.8 mean a Jaccard similarity of at least 2/3; the
chance that such a pair meets in no bucket is under 1e-4 there and falls
quickly above.

Equal texts are one class, compared once however many rows hold them; classes
that occur on both sides need no candidate search. Records also match by
their id in clean form.

Defined cases: rows with null split, or a split other than the named ones,
take no part; null texts and texts without words match by id only; a null id
matches nothing by id; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_id
from ..plans.shared import discard, materialize
from ..sources.tables import table
from . import bags as B
from .neardup import LOOSE, band_keys, completed, keyed, star_edges

BANDS, ROWS = 160, 7
THRESHOLD = 0.8


def _signed(bands: int, rows: int, seed: int = 7):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        k = bands * rows
        mul = rng.integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        add = rng.integers(0, 1 << 63, k, dtype=np.uint64)
        for b in batches:
            sets = b.column(1)
            values, offsets = sets.values.to_numpy(zero_copy_only=False).view(np.uint64), sets.offsets.to_numpy()
            for lo in range(0, b.num_rows, 1000):
                n = min(1000, b.num_rows - lo)
                least = np.full((n, k), np.iinfo(np.uint64).max, dtype=np.uint64)
                for i in range(n):
                    bag = values[offsets[lo + i] : offsets[lo + i + 1]]
                    for c in range(0, len(bag), 256):
                        np.minimum(least[i], (bag[c : c + 256, None] * mul[None, :] + add[None, :]).min(axis=0), out=least[i])
                yield keyed(b.column(0).slice(lo, n), band_keys(least, bands, rows))

    return run


def minwise(cls: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(uid, keys array<long>): the band keys of each class."""
    return cls.select("uid", "bag").mapInArrow(_signed(bands, rows), "uid bigint, keys array<bigint>")


def cross_pairs(cls: DataFrame, sides: DataFrame, threshold: float = THRESHOLD, tag: str = "cross") -> DataFrame:
    """(a, b): a class with rows in train and another or the same with evaluation
    rows, at or above the threshold. ``sides``: (uid, train, held) booleans.

    Buckets without both sides are dropped by the aggregation that finds their centres. The others are
    stars, verified loosely and completed across the splits in blocks, so a bucket that a boilerplate
    text fills gives as many edges as members."""
    side = sides.select("uid", (F.col("train").cast("int") + 2 * F.col("held").cast("int")).alias("side"))
    signed = materialize(minwise(cls).join(side, "uid"), f"{tag}-bands")
    edges = star_edges(signed, "sides = 3", tag)
    stars = materialize(B.verified(edges, cls, cls, min(LOOSE, threshold)), f"{tag}-stars")
    discard(edges)
    discard(signed)
    rest = completed(stars, side).join(stars.select("a", "b"), ["a", "b"], "left_anti")
    near = stars.where(F.col("similarity") >= threshold - 1e-9).select("a", "b").unionByName(B.verified(rest, cls, cls, threshold).select("a", "b"))
    x, y = (side.select(F.col("uid").alias(c), F.col("side").alias(f"s{c}")) for c in ("a", "b"))
    both = near.join(x, "a").join(y, "b")
    over = both.where("(sa & 1) = 1 and (sb & 2) = 2").select("a", "b").unionByName(both.where("(sb & 1) = 1 and (sa & 2) = 2").select(F.col("b").alias("a"), F.col("a").alias("b")))
    same = sides.where("train and held").select(F.col("uid").alias("a"), F.col("uid").alias("b"))
    return over.unionByName(same)


def _classed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, members, pairs): the rows taking part with their clean id, (uid, train, no) of those with
    words, and the class pairs (a with training rows, b with evaluation rows)."""
    rows = table(spark, sf_dir, "queries").where("split in ('train', 'dev', 'test') and query_no is not null")
    docs = materialize(B.bags(rows, F.concat_ws(":", (F.col("split") == "train").cast("int").cast("string"), F.col("query_no").cast("string")), F.col("text")), "queries-bags")
    cls = B.classes(docs, "queries-classes")
    held = docs.select((F.substring("key", 1, 1) == "1").alias("train"), F.expr("cast(substring(key, 3) as bigint)").alias("no"), "fp").join(cls.select("uid", "fp"), "fp").select("uid", "train", "no")
    members = materialize(held.distinct(), "queries-members")
    sides = members.groupBy("uid").agg(F.max("train").alias("train"), F.max(~F.col("train")).alias("held"))
    pairs = materialize(cross_pairs(cls, sides), "queries-pairs")
    discard(docs)
    discard(cls)
    return rows.select(clean_id("_id").alias("id"), (F.col("split") == "train").alias("train"), F.col("query_no").alias("no"), "split", "source").distinct(), members, pairs


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a train and an evaluation row with the same id or 0.8 shared words."""
    rows, members, pairs = _classed(spark, sf_dir)
    left = members.where("train").select(F.col("uid").alias("a"), F.col("no").alias("t"))
    right = members.where("not train").select(F.col("uid").alias("b"), F.col("no").alias("h"))
    by_text = pairs.join(left, "a").join(right, "b").select("t", "h")
    ids = rows.where("id is not null")
    by_id = ids.where("train").select("id", F.col("no").alias("t")).join(ids.where("not train").select("id", F.col("no").alias("h")), "id").select("t", "h")
    return by_text.unionByName(by_id).select(F.least("t", "h").alias("query_no_a"), F.greatest("t", "h").alias("query_no_b")).distinct()


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping pairs and rows concerned, per split and source of the evaluation row. Pairs are counted
    by class and by id, less those that are both, and never listed."""
    rows, members, pairs = _classed(spark, sf_dir)
    one = F.count(F.lit(1))
    all_ = rows.join(members.select("no", "train", "uid"), ["no", "train"], "left")
    train, held = all_.where("train"), all_.where("not train")
    by_text = pairs.join(train.where("uid is not null").groupBy(F.col("uid").alias("a")).agg(one.alias("k")), "a").groupBy(F.col("b").alias("uid")).agg(F.sum("k").alias("n_text"))
    by_id = train.where("id is not null").groupBy("id").agg(one.alias("n_id"))
    cells = train.where("id is not null and uid is not null").groupBy("id", F.col("uid").alias("a")).agg(one.alias("k"))
    asked = held.where("id is not null and uid is not null").select("id", F.col("uid").alias("b")).distinct()
    both = asked.join(cells, "id").join(pairs, ["a", "b"], "left_semi").groupBy("id", F.col("b").alias("uid")).agg(F.sum("k").alias("n_both"))
    z = lambda c: F.coalesce(c, F.lit(0))
    n = held.join(by_text, "uid", "left").join(by_id, "id", "left").join(both, ["id", "uid"], "left").withColumn("n", z("n_text") + z("n_id") - z("n_both")).where("n > 0")
    return n.groupBy("split", "source").agg(F.sum("n").alias("n_pairs"), one.alias("n_rows"))


def queries():
    return {"p7_found": p7_found, "p7_counts": p7_counts}


_SQL = r"""WITH q AS (
  SELECT query_no, split, source, text, upper(regexp_replace(regexp_replace(_id, '^[ \t]+|[ \t]+$', '', 'g'), '^.*/', '')) AS id
  FROM queries WHERE split IN ('train', 'dev', 'test')),
w AS (SELECT query_no, split, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM q),
c AS (SELECT query_no, split, w, count(*) AS n FROM w GROUP BY ALL),
s AS (SELECT query_no, sum(n) AS len FROM c GROUP BY ALL),
p AS (SELECT a.query_no AS t, b.query_no AS h, sum(least(a.n, b.n)) AS common
  FROM c a JOIN c b ON a.w = b.w AND a.split = 'train' AND b.split <> 'train' GROUP BY ALL),
o AS (
  SELECT t, h FROM p JOIN s x ON x.query_no = t JOIN s y ON y.query_no = h WHERE common >= 0.8 * greatest(x.len, y.len) - 1e-9
  UNION
  SELECT a.query_no, b.query_no FROM q a JOIN q b ON a.id = b.id AND a.split = 'train' AND b.split <> 'train')
"""


def oracle_sql():
    return {
        "p7_found": _SQL + "SELECT DISTINCT least(t, h) AS query_no_a, greatest(t, h) AS query_no_b FROM o",
        "p7_counts": _SQL + "SELECT q.split, q.source, count(*)::BIGINT AS n_pairs, count(DISTINCT h)::BIGINT AS n_rows FROM o JOIN q ON q.query_no = o.h GROUP BY ALL",
    }
