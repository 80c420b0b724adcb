"""Texts as bags of words, and the exact similarity of two of them.

A bag with repeats is written as the set of its elements (word, how many-th),
each hashed to 64 bits, so that set intersection counts repeats. The shared
words of two texts are the size of the intersection divided by the size of the
larger bag. Texts with the same bag form one class and are compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import materialize

#: Texts of a batch are worked on together up to this many characters; one longer text by itself.
CHUNK = 4 << 20
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def elements(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values): per text the sorted hashes of its (word, occurrence) pairs. Words are the
    maximal runs of letters or digits of the lower-cased text; all texts are worked on as columns."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pa.array(texts, pa.large_string())), r"[^\pL\pN]+", " ")
    lists = pc.split_pattern(pc.utf8_trim(plain, " "), " ")
    owner = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(lists)))
    words = pc.list_flatten(lists)
    some = np.asarray(pc.binary_length(words)) > 0  # a text without words is one empty string
    d = pc.dictionary_encode(words.filter(pa.array(some)))
    owner, code = owner[some], np.asarray(d.indices).astype(np.int64)
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in d.dictionary.to_pylist()], dtype=np.uint64)
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    first = np.r_[True, (np.diff(owner) != 0) | (np.diff(code) != 0)] if len(code) else np.empty(0, bool)
    nth = np.arange(len(code)) - np.maximum.accumulate(np.where(first, np.arange(len(code)), 0))
    with np.errstate(over="ignore"):
        values = mix(hashes[code] + nth.astype(np.uint64) * _GOLD) if len(code) else np.empty(0, np.uint64)
    values = values[np.lexsort((values, owner))]
    return np.searchsorted(owner, np.arange(len(texts) + 1)), values


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for k, t in enumerate(texts):
        if k > lo and size + len(t) > CHUNK:
            yield lo, k
            lo, size = k, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, texts = b.column(0), b.column(1).to_pylist()
        for lo, hi in _chunks(texts):
            offsets, values = elements(texts[lo:hi])
            prints = [xxhash.xxh128_digest(values[i:j].tobytes()) for i, j in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))], names=["key", "fp", "bag"])


def bags(df: DataFrame, key: Column, text: Column) -> DataFrame:
    """(key string, fp binary, bag array<long>) of each row with a non-null text."""
    slim = df.select(key.cast("string").alias("key"), text.alias("text")).where("key is not null and text is not null")
    return slim.mapInArrow(_bags, "key string, fp binary, bag array<bigint>")


def classes(docs: DataFrame, tag: str) -> DataFrame:
    """One row per distinct bag: (uid, fp, bag), written once so that uid is stable.
    Bags without a word are left out: they share no words with anything."""
    one = docs.where(F.size("bag") > 0).groupBy("fp").agg(F.first("bag").alias("bag"))
    return materialize(one.select(F.monotonically_increasing_id().alias("uid"), "fp", "bag"), tag)


def shared(a: str = "bag_a", b: str = "bag_b") -> Column:
    """Words that two bags share."""
    return F.size(F.array_intersect(a, b))


def larger(a: str = "bag_a", b: str = "bag_b") -> Column:
    return F.greatest(F.size(a), F.size(b))


def alike(threshold: float) -> Column:
    """Exact test: shared words / larger bag >= threshold, for columns bag_a and bag_b."""
    return shared() >= F.lit(threshold) * larger() - F.lit(1e-9)


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Of candidate pairs (a, b), those that pass the exact test. The length bound
    is tested before the bags are intersected."""
    x = left.select(F.col("uid").alias("a"), F.col("bag").alias("bag_a"))
    y = right.select(F.col("uid").alias("b"), F.col("bag").alias("bag_b"))
    joined = pairs.join(x, "a").join(y, "b")
    joined = joined.where(F.least(F.size("bag_a"), F.size("bag_b")) >= F.lit(threshold) * larger() - F.lit(1e-9))
    return joined.where(alike(threshold)).select("a", "b", (shared() / larger()).alias("similarity"))
