"""Near-duplicate records: one-permutation hashing, banded buckets, star edges.

1. Texts become bags of words; equal bags become one class (:mod:`.bags`).
2. One hash of each element puts it into one of ``BANDS * ROWS`` bins; a bin
   keeps its least hash. Empty bins are filled by optimal densification: bin
   i asks bins h(i,1), h(i,2), ... until one isn't empty, the same sequence for
   every text, so that the bins of two texts agree with the probability of
   their Jaccard similarity.
3. ``ROWS`` bins make a band; texts with an equal band meet in a bucket. Each
   bucket gives a star: edges from its least member to the others, so edges
   are at most as many as bucket entries, never their square. Buckets have no
   size limit.
4. Star edges are verified at the loose threshold ``LOOSE``, above which no
   unrelated texts of one vocabulary lie. Two texts that met in a bucket then
   both hang on its centre, so pairs are completed among the verified
   neighbours of one centre. (If the centre is a stranger to them, another of
   the nine and more buckets in which such a pair meets has to serve.) Neighbourhoods are joined in
   blocks of ``BLOCK`` members, so a centre with a third of all texts is many
   tasks, and each pair is verified exactly.

Two texts with 0.8 shared words have a Jaccard similarity of at least 2/3 as
bags. With 160 bands of 7 rows the chance that they never meet is under 1e-4
at that bound, and under 1e-7 from 0.72 on; unrelated texts of these
vocabularies (similarity 0.13) meet with 1e-4.

Defined cases: rows whose id, title or text is null or empty are left out; ids
with several texts are compared by each of them; equal texts are one class and
similar with 1; a text without words has no partner; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import discard, materialize
from ..plans.sizing import maybe_broadcast
from ..sources.tables import table
from . import bags as B
from .bags import _GOLD, _M1, _M2, mix
from .components import components

BANDS, ROWS = 160, 7
THRESHOLD, LOOSE = 0.8, 0.4
BLOCK = 256
#: Sketches that are made together.
GROUP = 256

def probes(bins: int, rounds: int) -> np.ndarray:
    """Densification: for each bin the sequence of bins it asks, the same for all texts."""
    with np.errstate(over="ignore"):
        i = np.arange(bins, dtype=np.uint64)[:, None] * _GOLD + np.arange(1, rounds + 1, dtype=np.uint64)[None, :] * _M2
    return (mix(i) % np.uint64(bins)).astype(np.int64)


def one_permutation(values: np.ndarray, offsets: np.ndarray, bins: int, steps: np.ndarray) -> np.ndarray:
    """Densified one-permutation sketches, a row of ``bins`` per non-empty set; set i holds the 64-bit
    hashes ``values[offsets[i]:offsets[i + 1]]``. All sets are densified together, round by round."""
    n = len(offsets) - 1
    values = values[offsets[0] : offsets[-1]]
    row = np.repeat(np.arange(n), np.diff(offsets))
    h = mix(values + _GOLD)
    cell = row * bins + (mix(values ^ _M1) % np.uint64(bins)).astype(np.int64)
    order = np.lexsort((h, cell))
    first = order[np.r_[True, np.diff(cell[order]) != 0]] if len(order) else order
    full = np.zeros(n * bins, dtype=bool)
    sketch = np.zeros(n * bins, dtype=np.uint64)
    full[cell[first]] = True
    sketch[cell[first]] = h[first]
    out = sketch.copy()
    at = np.flatnonzero(~full).astype(np.int32)
    which, base = at % bins, at - at % bins
    with np.errstate(over="ignore"):
        shifts = np.arange(1, steps.shape[1] + 1, dtype=np.uint64) * _GOLD
    for r in range(steps.shape[1]):
        if not len(at):
            return out.reshape(n, bins)
        source = base + steps[:, r].astype(np.int32)[which]
        hit = full[source]
        out[at[hit]] = sketch[source[hit]] + shifts[r]
        miss = ~hit
        at, which, base = at[miss], which[miss], base[miss]
    for i in at:  # after all rounds: the nearest full bin to the right
        where = np.flatnonzero(full[i - i % bins : i - i % bins + bins])
        out[i] = sketch[i - i % bins + where[np.searchsorted(where, i % bins) % len(where)]]
    return out.reshape(n, bins)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key per band of each sketch; the band's number is part of it."""
    with np.errstate(over="ignore"):
        key = np.arange(1, bands + 1, dtype=np.uint64) * _GOLD
        for r in range(rows):
            key = mix(key * _M1 + sketch[..., r::rows][..., :bands])
    return key


def keyed(uids: pa.Array, keys: np.ndarray) -> pa.RecordBatch:
    n, bands = keys.shape
    return pa.RecordBatch.from_arrays([uids, pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))], names=["uid", "keys"])


def _signed(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = bands * rows
        steps = probes(bins, 96)
        for b in batches:
            sets = b.column(1)
            values, offsets = sets.values.to_numpy(zero_copy_only=False).view(np.uint64), sets.offsets.to_numpy()
            with np.errstate(over="ignore"):
                for lo in range(0, b.num_rows, GROUP):
                    hi = min(b.num_rows, lo + GROUP)
                    yield keyed(b.column(0).slice(lo, hi - lo), band_keys(one_permutation(values, offsets[lo : hi + 1], bins, steps), bands, rows))

    return run


def banded(cls: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(uid, keys array<long>): the band keys of each class."""
    return cls.select("uid", "bag").mapInArrow(_signed(bands, rows), "uid bigint, keys array<bigint>")


def star_edges(signed: DataFrame, wanted: str = "true", tag: str = "stars") -> DataFrame:
    """Distinct edges (a, b) from the least member of each bucket to its others.

    ``signed``: (uid, keys, side), ``side`` a small set of bits; ``wanted`` is a condition on ``sides``, the
    bits of all members. One pre-aggregated pass gives each bucket's least and greatest member and its
    size: buckets of one are nothing, buckets of two are their edge, and only the larger ones, which
    are few, are joined with the entries again. No bucket is gathered."""
    entries = signed.select(F.explode("keys").alias("key"), "uid", "side")
    one = entries.groupBy("key").agg(F.min("uid").alias("a"), F.max("uid").alias("b"), F.count(F.lit(1)).alias("n"), F.bit_or("side").alias("sides"))
    one = materialize(one.where("a < b").where(wanted).select("key", "a", "b", "n"), f"{tag}-buckets")
    large = maybe_broadcast(one.where("n > 2").select("key", "a"))
    more = entries.select("key", F.col("uid").alias("b")).join(large, "key").where("a <> b").select("a", "b")
    edges = one.where("n = 2").select("a", "b").unionByName(more).distinct()
    edges._plumbline_path = one._plumbline_path  # discarding the edges discards the buckets' table
    return edges


def completed(stars: DataFrame, sides: DataFrame | None = None) -> DataFrame:
    """Candidate pairs among the neighbours of one centre, block by block. ``sides`` (uid, side): pairs
    of members whose bits together aren't 3 are left out before they are made."""
    size = stars.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = stars.select("a", "b").join(size, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("side", F.lit(3)) if sides is None else placed.join(sides.select(F.col("uid").alias("b"), "side"), "b")
    left = placed.select("a", F.col("b").alias("x"), F.col("side").alias("sx"), F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    right = placed.select("a", F.col("b").alias("y"), F.col("side").alias("sy"), F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    pairs = left.join(right, ["a", "i", "j"]).where("x < y and (sx | sy) = 3")
    return pairs.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def near_pairs(cls: DataFrame, threshold: float = THRESHOLD, tag: str = "neardup") -> DataFrame:
    """(a, b, similarity), a < b: all pairs of classes at or above the threshold."""
    signed = materialize(banded(cls).withColumn("side", F.lit(0)), f"{tag}-bands")
    edges = star_edges(signed, tag=tag)
    stars = materialize(B.verified(edges, cls, cls, min(LOOSE, threshold)), f"{tag}-stars")
    discard(edges)
    discard(signed)
    direct = stars.where(F.col("similarity") >= threshold - 1e-9)
    rest = completed(stars).join(stars.select("a", "b"), ["a", "b"], "left_anti")
    return direct.unionByName(B.verified(rest, cls, cls, threshold))


def _corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "corpus").where("title <> '' and text <> '' and _id is not null")
    docs = materialize(B.bags(rows, F.col("_id"), F.concat_ws(" ", "title", "text")), "corpus-bags")
    return docs, B.classes(docs, "corpus-classes")


def _members(docs: DataFrame, cls: DataFrame) -> DataFrame:
    return docs.select("key", "fp").distinct().join(cls.select("uid", "fp"), "fp").select("key", "uid")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of corpus ids whose texts have at least 0.8 shared words."""
    docs, cls = _corpus(spark, sf_dir)
    pairs = near_pairs(cls).select("a", "b")
    held = materialize(_members(docs, cls), "corpus-members")
    x, y = held.select(F.col("key").alias("x"), F.col("uid").alias("a")), held.select(F.col("key").alias("y"), F.col("uid").alias("b"))
    twins = held.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("uid").alias("a"), F.col("uid").alias("b"))
    both = pairs.unionByName(twins).join(x, "a").join(y, "b").where("x <> y")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per corpus id and text: the group's id (its least corpus id) and
    the group's size, groups being closed under pairs at or above the threshold."""
    docs, cls = _corpus(spark, sf_dir)
    group = components(near_pairs(cls).select("a", "b"), "neardup")
    held = _members(docs, cls).join(group.select(F.col("node").alias("uid"), "component"), "uid", "left").select("key", F.coalesce("component", "uid").alias("g"))
    sizes = held.groupBy("g").agg(F.min("key").alias("group_id"), F.countDistinct("key").alias("group_size"))
    return held.distinct().join(sizes, "g").select(F.col("key").alias("doc_id"), "group_id", "group_size").distinct()


def queries():
    return {"p4_found": p4_found, "p4_groups": p4_groups}


def oracle_sql():
    return {"p4_found": PAIRS_SQL}


PAIRS_SQL = r"""WITH d AS (
  SELECT DISTINCT _id AS id, title || ' ' || text AS t FROM corpus WHERE title <> '' AND text <> '' AND _id IS NOT NULL),
w AS (SELECT id, t, unnest(regexp_extract_all(lower(t), '[\p{L}\p{N}]+')) AS w FROM d),
c AS (SELECT id, t, w, count(*) AS n FROM w GROUP BY ALL),
s AS (SELECT id, t, sum(n) AS len FROM c GROUP BY ALL),
p AS (
  SELECT a.id AS x, a.t AS tx, b.id AS y, b.t AS ty, sum(least(a.n, b.n)) AS common
  FROM c a JOIN c b ON a.w = b.w AND a.id < b.id GROUP BY ALL)
SELECT DISTINCT p.x AS id_a, p.y AS id_b FROM p JOIN s sx ON sx.id = p.x AND sx.t = p.tx JOIN s sy ON sy.id = p.y AND sy.t = p.ty
WHERE common >= 0.8 * greatest(sx.len, sy.len) - 1e-9"""
