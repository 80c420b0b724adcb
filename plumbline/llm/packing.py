"""Filling containers of fixed capacity with documents, by vector best-fit.

Sizes are tokens of a public tokenizer. A container has three capacities: its
tokens, a number of documents, and an attention cost (the sum of squared
lengths, as each document attends to itself). A document longer than the
container is cut into full pieces and a rest; others are never cut. A piece
whose cost alone reaches the attention capacity has a container to itself.

Full pieces fill a container each, without any shuffle. The rest is dealt by
hash to shards of about ``SHARD_TOKENS`` tokens. Each shard is packed in
decreasing order: a piece goes to the open container that has room under every
constraint and wins by ``score``: ``dot`` takes the greatest weighted dot
product of the piece and the room left, ``norm`` the least weighted norm of
the room that stays. Containers under ``REPACK`` full are opened again and
their pieces packed a second time, many shards to one, so that what a shard
can't fill isn't lost.

Defined cases: null and empty texts have no tokens and no container; repeated
documents are packed each; no documents give no rows; containers with null or
non-positive capacity are left out.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import materialize
from ..plans.sizing import maybe_broadcast
from ..sources.tables import table

#: Vocabulary file, a parameter; the file isn't part of this package.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to that vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHARD_TOKENS = 1_500_000
SECOND_SHARDS = 64
REPACK = 0.98
#: Average tokens per document that the document-count capacity allows for.
LEAST_AVERAGE = 16
#: Weights of the token, document-count and attention dimensions.
WEIGHTS = (1.0, 0.02, 0.05)
#: Attention capacity as a share of the cost of one document that fills the container. Under 1 it
#: can bind: a container that one long document nearly fills takes no others.
ATTENTION = 0.97
#: Texts are encoded in slices at blanks of about so many characters, which gives the same tokens.
SLICE = 100_000


def _tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(enc, text: str) -> int:
    """Tokens of the whole text, encoded slice by slice. A slice ends before a blank
    that follows a letter, where the split pattern always starts a new unit."""
    n, lo = 0, 0
    while len(text) - lo > SLICE:
        hi = lo + SLICE
        while hi < len(text) - 1 and not (text[hi] == " " and text[hi - 1].isalpha() and text[hi + 1].isalpha()):
            hi += 1
        if hi >= len(text) - 1:
            break
        n += len(enc.encode_ordinary(text[lo:hi]))
        lo = hi
    return n + len(enc.encode_ordinary(text[lo:]))


def _counted(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = None
        for p in batches:
            enc = enc or _tokenizer(path)
            yield pd.DataFrame({"doc_id": p["doc_id"], "tokens": [count_tokens(enc, t) for t in p["text"]]}).astype({"tokens": "int64"})

    return run


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) of every document with a text."""
    slim = docs.select("doc_id", "text").where("doc_id is not null and text is not null and text <> ''")
    return slim.mapInPandas(_counted(path), "doc_id bigint, tokens bigint")


def pieces(counts: DataFrame, kinds: DataFrame) -> DataFrame:
    """(container_kind, capacity, doc_id, piece, tokens): documents cut only where they
    exceed the capacity. The handful of kinds meets every document, as each asks for."""
    k = kinds.where("container_kind is not null and capacity_tokens > 0").select("container_kind", F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct()
    listed = k.agg(F.collect_list(F.struct("container_kind", "capacity")).alias("kinds"))
    each = counts.where("tokens > 0").crossJoin(F.broadcast(listed)).select("doc_id", "tokens", F.inline("kinds"))
    cut = each.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("tokens") - 1) / F.col("capacity")))))
    return cut.select("container_kind", "capacity", "doc_id", F.col("piece").cast("int").alias("piece"), F.least(F.col("capacity"), F.col("tokens") - F.col("piece") * F.col("capacity")).alias("tokens"))


def pack(sizes: np.ndarray, capacity: int, score: str = "norm", weights: tuple = WEIGHTS, max_docs: int | None = None, attention: float = ATTENTION) -> np.ndarray:
    """Bin number of each piece, sizes in decreasing order and none above the capacity.

    Room is kept relative to each capacity. Containers that can't take even the
    smallest piece are closed."""
    docs = max_docs or max(1, capacity // LEAST_AVERAGE)
    w = np.array(weights)
    n = len(sizes)
    where = np.empty(n, dtype=np.int64)
    room = np.empty((max(16, n), 3))
    open_bins = np.empty(0, dtype=np.int64)
    used = 0
    least = sizes[-1] / capacity if n else 0.0
    for i, s in enumerate(sizes):
        v = np.array([s / capacity, 1 / docs, min(1.0, s * s / (attention * capacity * capacity))])
        pick = -1
        if len(open_bins):
            r = room[open_bins]
            fits = np.flatnonzero((r >= v - 1e-12).all(axis=1))
            if len(fits):
                left = r[fits]
                value = -(left * v * w).sum(axis=1) if score == "dot" else (w * (left - v) ** 2).sum(axis=1)
                pick = open_bins[fits[np.argmin(value)]]
        if pick < 0:
            pick = used
            room[pick] = 1.0
            used += 1
            open_bins = np.append(open_bins, pick)
        room[pick] -= v
        where[i] = pick
        if room[pick, 0] < least - 1e-12 or room[pick, 1] < 1 / docs - 1e-12 or room[pick, 2] < least * least / attention - 1e-12:
            open_bins = open_bins[open_bins != pick]
    return where


def _packed(score: str, label: str, attention: float):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins = pack(p["tokens"].to_numpy(), int(p["capacity"].iloc[0]), score, attention=attention)
        kind, shard = p["container_kind"].iloc[0], p["shard"].iloc[0]
        out = p[["container_kind", "capacity", "doc_id", "piece", "tokens"]].copy()
        out["container_id"] = [f"{kind}-{label}{shard}-{b}" for b in bins]
        total = np.bincount(bins, weights=p["tokens"].to_numpy())
        out["filled"] = total[bins] / p["capacity"].to_numpy()
        return out

    return run


_SCHEMA = "container_kind string, capacity bigint, doc_id bigint, piece int, tokens bigint, container_id string, filled double"


def fill(items: DataFrame, score: str = "norm", tag: str = "packing", attention: float = ATTENTION) -> DataFrame:
    """(container_kind, capacity, doc_id, piece, tokens, container_id) of pieces."""
    full = items.where("tokens = capacity").withColumn("container_id", F.concat_ws("-", "container_kind", F.lit("full"), "doc_id", "piece"))
    rest = items.where("tokens < capacity")
    totals = rest.groupBy("container_kind").agg(F.sum("tokens").alias("t")).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("t") / SHARD_TOKENS)).cast("bigint")).select("container_kind", "shards")
    totals = maybe_broadcast(materialize(totals, f"{tag}-shards"))  # a row per kind
    dealt = rest.join(totals, "container_kind").withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.col("shards")))
    first = materialize(dealt.groupBy("container_kind", "shard").applyInPandas(_packed(score, "a", attention), _SCHEMA), tag)
    loose = first.where(F.col("filled") < REPACK).join(totals, "container_kind")
    again = loose.withColumn("shard", F.pmod(F.xxhash64("piece", "doc_id"), F.ceil(F.col("shards") / SECOND_SHARDS))).groupBy("container_kind", "shard").applyInPandas(_packed(score, "b", attention), _SCHEMA)
    cols = ["container_kind", "capacity", "doc_id", "piece", "tokens", "container_id"]
    return full.select(*cols).unionByName(first.where(F.col("filled") >= REPACK).select(*cols)).unionByName(again.select(*cols))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = materialize(token_counts(table(spark, sf_dir, "documents")), "token-counts")
    return pieces(counts, table(spark, sf_dir, "containers"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's container or, if it is longer than one, containers, per kind."""
    return fill(_pieces(spark, sf_dir)).select("container_kind", "container_id", "doc_id", "piece", "tokens")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind and scoring: containers used, the fewest possible by tokens, and the share of room filled."""
    out, items = None, _pieces(spark, sf_dir)
    for score in ("norm", "dot"):
        f = fill(items, score).groupBy("container_kind", "capacity").agg(F.count_distinct("container_id").alias("n_containers"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_pieces"))
        f = f.select(F.lit(score).alias("score"), "container_kind", "n_containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("fewest"), "n_pieces", F.round(F.col("tokens") / (F.col("n_containers") * F.col("capacity")), 6).alias("filled"))
        out = f if out is None else out.unionByName(f)
    return out


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind, what must hold: documents laid, containers over a capacity, pieces laid twice, documents
    cut though they fit, documents not laid whole, and whether the containers are within a hundredth of the fewest possible."""
    items = _pieces(spark, sf_dir)
    f = materialize(fill(items), "packed")
    k = F.col("capacity")
    room = f.groupBy("container_kind", "capacity", "container_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.sum(F.col("tokens") * F.col("tokens")).alias("c"))
    over = (F.col("t") > k) | (F.col("n") > F.greatest(F.lit(1), F.floor(k / LEAST_AVERAGE))) | ((F.col("n") > 1) & (F.col("c") > ATTENTION * k * k + 1e-6))
    a = room.groupBy("container_kind", "capacity").agg(F.count_if(over).alias("n_over"), F.count(F.lit(1)).alias("bins"), F.sum("t").alias("t"))
    docs = f.groupBy("container_kind", "capacity", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("piece").alias("d"), F.sum("tokens").alias("t"))
    want = items.groupBy("container_kind", "doc_id").agg(F.sum("tokens").alias("want"))
    b = docs.join(want, ["container_kind", "doc_id"], "full").groupBy("container_kind").agg(F.count_if(F.col("n") > F.col("d")).alias("n_twice"), F.count_if((F.col("n") > 1) & (F.col("want") <= k)).alias("n_cut"), F.count_if(~F.col("t").eqNullSafe(F.col("want"))).alias("n_lost"), F.count(F.lit(1)).alias("n_documents"))
    return a.join(b, "container_kind").select("container_kind", "n_documents", "n_over", "n_twice", "n_cut", "n_lost", (F.col("bins") <= F.ceil(F.col("t") / k) * 1.01 + 3).alias("tight"))


def queries():
    return {"p8_containers": p8_containers, "p8_fill": p8_fill, "p8_invariants": p8_invariants}


def oracle_sql():
    return {"p8_invariants": "SELECT container_kind, (SELECT count(*) FROM documents WHERE text <> '') AS n_documents, 0::BIGINT AS n_over, 0::BIGINT AS n_twice, 0::BIGINT AS n_cut, 0::BIGINT AS n_lost, true AS tight FROM containers"}
