"""Retrieval: lexical, dense, sparse, late-interaction and fingerprint scoring.

Lexical scoring looks up query terms alone: their occurrences are shuffled
once, by document, and counted. ``bm25`` then joins them with the queries and
sums in the document's task. ``bm25_top``, where only the best are asked for,
multiplies a batch of documents with the matrix of terms and queries instead
and keeps the k best per query in each task, so that pairs of queries and
documents are never rows.

Vector scoring meets a stated query set with all rows in blocks of a bounded
size, each sent to all tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..plans.catalog import Catalogue, rel, withs
from ..plans.shared import materialize
from ..plans.sizing import BROADCAST_BYTES, maybe_broadcast, planned_bytes, small
from ..sources.tables import table
from .ranking import by_score, ranked

CAT = Catalogue()
queries, oracle_sql = CAT.queries, CAT.oracle_sql


def postings(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, term, tf, dl): the length is counted in the same pass, no second scan."""
    t = docs.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), words(text).alias("w"))
    return t.select("doc", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("doc", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def ws_tokens(c: str | Column) -> Column:
    """Lower-cased pieces between white space."""
    return F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != "")


def bm25(docs: DataFrame, qs: DataFrame, k1: float = 1.5, b: float = 0.75, doc: str = "doc_id", query: str = "query_id", tokens=words, idf: str = "lucene") -> DataFrame:
    """(query_id, doc_id, score) of documents that share a term with the query; repeated query
    terms count repeatedly. ``idf``: ``lucene`` ln((N - df + 0.5) / (df + 0.5) + 1); ``okapi`` without
    the 1, terms in more than half of the documents at a quarter of the mean; ``sum`` adds each distinct
    term's lucene idf once, however often it occurs."""
    q = qs.select(F.col(query).alias("q"), F.explode(tokens("text")).alias("term")).groupBy("q", "term").agg(F.count(F.lit(1)).alias("qf"))
    terms = maybe_broadcast(q.select("term").distinct())
    toks = docs.where("text is not null").select(F.col(doc).alias("doc"), tokens("text").alias("w")).select("doc", F.size("w").alias("dl"), "w")
    size = toks.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))  # one row
    # terms of queries alone reach the shuffle, which is by document for all that follows
    hit = toks.select("doc", "dl", F.explode("w").alias("term")).join(terms, "term", "left_semi").repartition("doc").groupBy("doc", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n, d = F.col("n"), F.col("df")
    if idf == "okapi":
        every = toks.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        raw = F.log(n - d + 0.5) - F.log(d + 0.5)
        mean = every.crossJoin(F.broadcast(size)).agg(F.avg(raw).alias("mean"))  # one row
        df = df.crossJoin(F.broadcast(size)).crossJoin(F.broadcast(mean)).select("term", F.when(raw < 0, 0.25 * F.col("mean")).otherwise(raw).alias("idf"))
    else:
        df = df.crossJoin(F.broadcast(size)).select("term", F.log((n - d + 0.5) / (d + 0.5) + 1).alias("idf"))
    weight = F.lit(1.0) if idf == "sum" else F.col("qf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    j = hit.join(maybe_broadcast(q.join(df, "term")), "term").crossJoin(F.broadcast(size))
    return j.groupBy("q", "doc").agg(F.sum(F.col("idf") * weight).alias("score")).select(F.col("q").alias(query), F.col("doc").alias(doc), "score")


#: Cells of the matrix of terms and queries that a task holds at most; more queries go in blocks.
MATRIX_CELLS = 8_000_000


def _best(q: np.ndarray, d: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query: score to nine digits, then the lesser document."""
    order = np.lexsort((d, -np.round(s, 9), q))
    first = np.r_[True, np.diff(q[order]) != 0]
    start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < k]


def _scores(terms: np.ndarray, asked: np.ndarray, qf: np.ndarray, idf: np.ndarray, n_queries: int, avgdl: float, k1: float, b: float, k: int):
    """Rows (doc, dl, tid, tf), those of a document together, to the k best (query, doc, score) of the task."""

    def run(batches):
        m = np.zeros((len(idf), n_queries))
        m[terms, asked] = qf
        m *= idf[:, None]
        kept = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        least = np.zeros(n_queries)
        rest: list[pa.RecordBatch] = []

        def take(x: pa.Table) -> None:
            nonlocal kept, least
            doc, dl, tid, tf = (x.column(c).to_numpy() for c in ("doc", "dl", "tid", "tf"))
            w = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
            cuts = np.flatnonzero(np.r_[True, np.diff(doc) != 0])
            score = np.add.reduceat(m[tid] * w[:, None], cuts, axis=0)
            i, q = np.nonzero((score > 0) & (np.round(score, 9) >= least))
            new = [np.concatenate(p) for p in zip(kept, (q, doc[cuts][i], score[i, q]))]
            at = _best(*new, k)
            kept = [p[at] for p in new]
            full = np.bincount(kept[0], minlength=n_queries) >= k
            low = np.full(n_queries, np.inf)
            np.minimum.at(low, kept[0], np.round(kept[2], 9))
            least = np.where(full, low, 0.0)

        for x in batches:
            if not x.num_rows:
                continue
            t = pa.Table.from_batches([*rest, x])
            doc = t.column("doc").to_numpy()
            whole = int(np.searchsorted(doc, doc[-1], "left"))  # the last document may go on
            if whole:
                take(t.slice(0, whole))
            rest = t.slice(whole).to_batches()
        if rest:
            take(pa.Table.from_batches(rest))
        yield pa.RecordBatch.from_arrays([pa.array(kept[0], pa.int64()), pa.array(kept[1], pa.int64()), pa.array(kept[2], pa.float64())], ["q", "doc", "score"])

    return run


def bm25_top(docs: DataFrame, qs: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, doc: str = "doc_id", query: str = "query_id") -> DataFrame:
    """The k best documents of each query by ``bm25``'s lucene form, with their ``rank``; both ids are
    integers. The queries are a stated set: their terms and frequencies are gathered, and beyond
    ``MATRIX_CELLS`` they are worked on in blocks over one table of occurrences."""
    spark = docs.sparkSession
    q = qs.select(F.col(query).alias("q"), F.explode(words("text")).alias("term")).groupBy("q", "term").agg(F.count(F.lit(1)).alias("qf"))
    asked = q.toPandas()
    names, tid = np.unique(asked["term"].to_numpy(dtype=str), return_inverse=True)
    ids, qid = np.unique(asked["q"].to_numpy(), return_inverse=True)
    if not len(names):
        return spark.createDataFrame([], f"{query} bigint, {doc} bigint, score double, rank int")
    # every document has one occurrence of the empty term, so that lengths come with the same pass
    terms = maybe_broadcast(spark.createDataFrame(pd.DataFrame({"term": ["", *names.tolist()], "tid": np.arange(-1, len(names))})))
    toks = docs.where("text is not null").select(F.col(doc).alias("doc"), words("text").alias("w"))
    hit = toks.select("doc", F.size("w").alias("dl"), F.explode(F.concat("w", F.array(F.lit("")))).alias("term")).join(terms, "term").repartition("doc").groupBy("doc", "dl", "tid").agg(F.count(F.lit(1)).alias("tf"))
    hit = materialize(hit.sortWithinPartitions("doc"), "occurrences")
    found = hit.groupBy("tid").agg(F.count(F.lit(1)).alias("df"), F.avg("dl").alias("dl")).toPandas()  # at most a row per term of the queries
    df = np.zeros(len(names) + 1)
    df[found["tid"].to_numpy(dtype=int)] = found["df"]  # the empty term stands last
    avgdl = max(1e-9, float(found["dl"][found["tid"] == -1].sum()))
    idf = np.log((df[-1] - df[:-1] + 0.5) / (df[:-1] + 0.5) + 1)
    step = max(1, MATRIX_CELLS // len(names))
    out = None
    # occurrences are sorted by document again: a written file may be cut anywhere
    rows = hit.where("tid >= 0").repartition("doc").sortWithinPartitions("doc")
    for lo in range(0, len(ids), step):
        at = np.flatnonzero((qid >= lo) & (qid < lo + step))
        run = _scores(tid[at], qid[at] - lo, asked["qf"].to_numpy()[at], idf, min(step, len(ids) - lo), avgdl, k1, b, k)
        part = rows.mapInArrow(run, "q bigint, doc bigint, score double").select((F.col("q") + lo).alias("q"), "doc", "score")
        out = part if out is None else out.unionByName(part)
    named = spark.createDataFrame(pd.DataFrame({"q": np.arange(len(ids)), query: ids}))
    best = ranked(out, ["q"], by_score("score", "doc"), k)
    return best.join(maybe_broadcast(named), "q").select(query, F.col("doc").alias(doc), "score", "rank")


#: Documents or queries in a block, about, blocks of documents that one task takes in turn, and blocks of queries at least.
BLOCK_ROWS, BLOCKS_A_TASK, MANY_TASKS = 4096, 8, 12
#: Occurrences of terms in pairs that a task adds up at once: with blocks of BLOCK_ROWS, all at once were most of its memory.
SHARED_AT_ONCE = 1 << 20
#: A term that this share of all pairs has in common is a column of the dense product; the others are joined.
DENSE_SHARE = 1e-3
_BLOCK = "block int, ids binary, starts binary, terms binary, u binary, tf binary, x binary"


def _packed(per_row: bool):
    """Rows (block, n, tid, x) of one block, a row per occurrence, as one row of arrays: for each n its terms with
    their counts. ``x`` belongs to n, or else to the term."""

    def run(t: pa.Table) -> pa.Table:
        n, tid, x = (t.column(c).to_numpy() for c in ("n", "tid", "x"))
        order = np.lexsort((tid, n))
        n, tid, x = n[order], tid[order], x[order]
        at = np.flatnonzero(np.r_[True, (np.diff(n) != 0) | (np.diff(tid) != 0)])
        tf = np.diff(np.r_[at, len(n)])
        n, tid, x = n[at], tid[at], x[at]
        heads = np.flatnonzero(np.r_[True, np.diff(n) != 0])
        terms, where, u = np.unique(tid, return_index=True, return_inverse=True)
        arrays = (n[heads], np.r_[heads, len(n)].astype(np.int32), terms, u.astype(np.int32), tf.astype(np.int32), x[heads if per_row else where].astype(np.float64))
        return pa.table([t.column("block").slice(0, 1).cast(pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)], names=["block", "ids", "starts", "terms", "u", "tf", "x"])

    return run


class _Rows:
    """A block read back."""

    def __init__(self, batch: pa.RecordBatch, row: int, side: str):
        kinds = {"ids": np.int64, "starts": np.int32, "terms": np.int64, "u": np.int32, "tf": np.int32, "x": np.float64}
        for c, kind in kinds.items():
            setattr(self, c, np.frombuffer(batch.column(side + c)[row].as_py(), kind))
        self.row = np.repeat(np.arange(len(self.ids)), np.diff(self.starts))

    def split(self, weight: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The matrix of the dense terms, and (term, row, weight) of the others by term."""
        column = np.searchsorted(dense, self.terms)
        held = np.zeros(len(self.terms), bool)
        some = column < len(dense)
        held[some] = dense[column[some]] == self.terms[some]
        m = np.zeros((len(self.ids), len(dense)), np.float32)
        e = held[self.u]
        m[self.row[e], column[self.u[e]]] = weight[e]
        rest = np.flatnonzero(~e)
        rest = rest[np.argsort(self.u[rest], kind="stable")]
        return m, (self.terms[self.u[rest]], self.row[rest], weight[rest].astype(np.float32))


def _product(q: _Rows, d: _Rows, qw: np.ndarray, dw: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Sums over the shared terms of all pairs of two blocks, in single precision."""
    a, (qt, qr, qv) = q.split(qw, dense)
    b, (dt, dr, dv) = d.split(dw, dense)
    s = np.ascontiguousarray(a @ b.T)
    lo = np.searchsorted(qt, dt, "left")
    n = np.searchsorted(qt, dt, "right") - lo
    end, at = np.cumsum(n), 0
    while at < len(dt):  # a bounded number of shared occurrences at once, or those of one row
        to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + SHARED_AT_ONCE, "right")))
        m = n[at:to]
        e = np.repeat(np.arange(at, to), m)
        f = np.arange(len(e)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[at:to], m)
        np.add.at(s.reshape(-1), qr[f].astype(np.int64) * len(d.ids) + dr[e], qv[f] * dv[e])
        at = to
    return s


def _kth_of_rows(s: np.ndarray, rows: np.ndarray, k: int, chunk: int = 256) -> np.ndarray:
    """The k-th greatest of each of the rows, copied some at a time."""
    return np.concatenate([np.partition(s[rows[at : at + chunk]], s.shape[1] - k, axis=1)[:, -k] for at in range(0, len(rows), chunk)])


def _exactly(q: _Rows, docs: list[_Rows], qw: np.ndarray, dws: list[np.ndarray], i: np.ndarray, at: np.ndarray, j: np.ndarray, chunk: int = 256) -> np.ndarray:
    """Scores in double precision of the pairs (query i, document j of block ``at``)."""
    out = np.zeros(len(i))
    x = np.zeros((chunk, len(q.terms) + 1))
    maps = []
    for d in docs:
        p = np.minimum(np.searchsorted(q.terms, d.terms), len(q.terms) - 1)
        maps.append(np.where(q.terms[p] == d.terms, p, len(q.terms)))
    order = np.argsort(i, kind="stable")
    for lo in range(0, len(q.ids), chunk):
        e = slice(q.starts[lo], q.starts[min(lo + chunk, len(q.ids))])
        x[q.row[e] - lo, q.u[e]] = qw[e]
        mine = order[np.searchsorted(i[order], lo) : np.searchsorted(i[order], lo + chunk)]
        for k in np.unique(at[mine]):
            d, pairs = docs[k], mine[at[mine] == k]
            n = d.starts[j[pairs] + 1] - d.starts[j[pairs]]
            f = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(d.starts[j[pairs]], n)
            v = x[np.repeat(i[pairs] - lo, n), maps[k][d.u[f]]] * dws[k][f]
            out[pairs] = np.bincount(np.repeat(np.arange(len(pairs)), n), weights=v, minlength=len(pairs))
        x[q.row[e] - lo, q.u[e]] = 0.0
    return out


def _best_of_blocks(dense: np.ndarray, k: int, k1: float, b: float, avgdl: float, plain: bool):
    """Pairs of a block of queries and one of documents to the k best (q, d, score) of all that a task meets.
    Single precision, with a bound of its error, only rules out; what it leaves open is summed again in double."""

    def run(batches):
        queries, docs, kept = {}, {}, {}

        def settle(key: int) -> None:
            q, qw, err, least, _ = queries[key]
            i, at, j, _ = kept[key]
            s = _exactly(q, [d for d, _ in docs.values()], qw, [w for _, w in docs.values()], i, at, j)
            ids = [d.ids for d, _ in docs.values()]
            of = np.array([ids[a][r] for a, r in zip(at, j)], dtype=np.int64)
            best = _best(i, of, s, k)
            kept[key] = [x[best] for x in (i, at, j, s)]

        def kth(key: int) -> None:
            """The k-th best so far, less the error, bounds what may still come."""
            q, qw, err, least, _ = queries[key]
            i, at, j, s = kept[key]
            order = np.lexsort((-s, i))
            first = np.searchsorted(i[order], np.arange(len(q.ids)))
            full = np.bincount(i, minlength=len(q.ids)) >= k
            least[full] = np.maximum(least[full], s[order[first[full] + k - 1]] - 2 * err[full])
            stay = s >= least[i]
            kept[key] = [x[stay] for x in (i, at, j, s)]

        for x in batches:
            for row in range(x.num_rows):
                key, other = x.column("q_block")[row].as_py(), x.column("d_block")[row].as_py()
                if key not in queries:
                    q = _Rows(x, row, "q_")
                    qw = q.x[q.u] if plain else q.tf * q.x[q.u]
                    n, total = np.diff(q.starts), np.bincount(q.row, weights=np.abs(qw), minlength=len(q.ids))
                    queries[key] = q, qw, 2.0**-23 * (n + 8) * total * (1.0 if plain else k1 + 1), np.full(len(q.ids), -np.inf), np.bincount(q.row, weights=qw <= 0, minlength=len(q.ids)).any()
                    kept[key] = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
                if other not in docs:
                    d = _Rows(x, row, "d_")
                    docs[other] = d, np.ones(len(d.u)) if plain else d.tf * (k1 + 1) / (d.tf + k1 * (1 - b + b * d.x[d.row] / avgdl))
                q, qw, err, least, signed = queries[key]
                d, dw = docs[other]
                s = _product(q, d, qw, dw, dense)
                if signed:  # a shared term may add nothing, or less
                    s[_product(q, d, np.ones(len(q.u)), np.ones(len(d.u)), dense) < 0.5] = -np.inf
                open_ = np.flatnonzero(np.isinf(least))
                if len(open_) and s.shape[1] > k:
                    least[open_] = _kth_of_rows(s, open_, k) - 2 * err[open_]
                bound = np.where(np.isinf(least) | signed, np.maximum(least, np.finfo(np.float32).min), np.maximum(least, 0.0))
                # down to the next single number, so that rounding the bound itself rules nothing out
                bound = np.nextafter(bound.astype(np.float32), np.float32(-np.inf))
                i, j = np.divmod(np.flatnonzero(s >= bound[:, None]) if signed else np.flatnonzero((s >= bound[:, None]) & (s > 0)), s.shape[1])
                new = (i, np.full(len(i), list(docs).index(other)), j, s[i, j].astype(float))
                kept[key] = [np.concatenate(p) for p in zip(kept[key], new)]
                kth(key)
                if len(kept[key][0]) > 4 * k * len(q.ids) + 100_000:  # many equal scores
                    settle(key)
        for key, (q, *_) in queries.items():
            settle(key)
            i, at, j, s = kept[key]
            ids = [d.ids for d, _ in docs.values()]
            of = np.array([ids[a][r] for a, r in zip(at, j)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(q.ids[i], pa.int64()), pa.array(of, pa.int64()), pa.array(s, pa.float64())], ["q", "d", "score"])

    return run


def _numbered(rows: DataFrame, id_col: str, tag: str) -> DataFrame:
    """(n, id, text), numbered in the order of the ids."""
    r = rows.where("text is not null").select(F.col(id_col).alias("id"), "text").orderBy("id")
    return materialize(r.select(F.monotonically_increasing_id().alias("n"), "id", "text"), tag)


def bm25_best(docs: DataFrame, qs: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, doc: str = "doc_id", query: str = "query_id", tokens=words, idf: str = "lucene") -> DataFrame:
    """The k best documents of each query by :func:`bm25`, of the same forms, with their ``rank``; ids of any type,
    each once. Queries may be as many as documents: both are packed into blocks, and every two blocks meet once,
    so that neither pairs nor occurrences of pairs are ever rows."""
    docs, qs = _numbered(docs, doc, "lexical-documents"), _numbered(qs, query, "lexical-queries")
    toks = docs.select("n", tokens("text").alias("w")).select("n", F.size("w").alias("dl"), "w")
    size, asked = toks.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first(), qs.count()
    total, avgdl = size["n"], size["avgdl"] or 1.0
    q = qs.select("n", F.explode(tokens("text")).alias("term"))
    terms = materialize(q.groupBy("term").agg(F.count_distinct("n").alias("asked")).withColumn("tid", F.monotonically_increasing_id()), "lexical-terms")
    occur = toks.select("n", "dl", F.explode("w").alias("term")).join(maybe_broadcast(terms.select("term", "tid")), "term")
    n_d = max(1, math.ceil(total / BLOCK_ROWS))
    n_q = max(1, min(asked, max(MANY_TASKS, math.ceil(asked / BLOCK_ROWS))))
    block = lambda n: F.pmod(F.xxhash64("n"), F.lit(n)).cast("int").alias("block")
    d_blocks = materialize(occur.select(block(n_d), "n", "tid", F.col("dl").cast("double").alias("x")).groupBy("block").applyInArrow(_packed(True), _BLOCK), "lexical-blocks")

    def counts(batches):
        for x in batches:
            for r in range(x.num_rows):
                rows = _Rows(x, r, "")
                yield pa.RecordBatch.from_arrays([pa.array(rows.terms), pa.array(np.bincount(rows.u, minlength=len(rows.terms)), pa.int64())], ["tid", "df"])

    df = d_blocks.mapInArrow(counts, "tid bigint, df bigint").groupBy("tid").agg(F.sum("df").alias("df"))
    c = F.col("df")
    raw = F.log(total - c + 0.5) - F.log(c + 0.5)
    if idf == "okapi":
        every = toks.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        weight = F.when(raw < 0, 0.25 * (every.agg(F.avg(raw)).first()[0] or 0.0)).otherwise(raw)
    else:
        weight = F.log((total - c + 0.5) / (c + 0.5) + 1)
    weights = materialize(terms.join(df, "tid").select("term", "tid", "asked", "df", weight.alias("x")), "lexical-weights")
    # by the share, there are at most some thousands, however many terms there are
    dense = np.sort(np.array([r[0] for r in weights.where(F.col("asked") * F.col("df") > DENSE_SHARE * total * asked).select("tid").collect()], dtype=np.int64))
    q_blocks = materialize(q.join(maybe_broadcast(weights.select("term", "tid", "x")), "term").select(block(n_q), "n", "tid", "x").groupBy("block").applyInArrow(_packed(False), _BLOCK), "lexical-asked")
    named = lambda t, side: t.select(*(F.col(x).alias(side + x) for x in t.columns))
    left = named(q_blocks, "q_").repartitionByRange(n_q, "q_block")
    right = named(d_blocks, "d_").repartitionByRange(math.ceil(n_d / BLOCKS_A_TASK), "d_block")
    pairs = left.hint("shuffle_replicate_nl").crossJoin(right)
    found = pairs.mapInArrow(_best_of_blocks(dense, k, k1, b, avgdl, idf == "sum"), "q bigint, d bigint, score double")
    best = ranked(found, ["q"], by_score("score", "d"), k)
    best = best.join(qs.select(F.col("n").alias("q"), F.col("id").alias(query)), "q").join(docs.select(F.col("n").alias("d"), F.col("id").alias(doc)), "d")
    return best.select(query, doc, "score", "rank")


_BM = """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {t} WHERE text IS NOT NULL), n AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
p AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT query_id, term, count(*) AS qf FROM (SELECT {q} AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {s}) GROUP BY 1, 2),
b AS (SELECT query_id, doc_id, sum(qf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25 + 0.75::DOUBLE * dl / avgdl))) AS score FROM q JOIN tf USING (term) JOIN df USING (term), n GROUP BY 1, 2)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM b) WHERE rank <= 10"""


@CAT.query("ret_bm25_lucene", _BM.format(t="documents", q="item_id", s="eval_items"))
def _bm25(spark, d):
    """Ten best documents for every evaluation item."""
    items = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "text")
    return bm25_top(table(spark, d, "documents").select("doc_id", "text"), items, 10).withColumn("score", F.round("score", 6))


@CAT.query("join_postings", """WITH q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM eval_items), p AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents WHERE text IS NOT NULL)
SELECT term, count(DISTINCT doc_id) AS n_documents FROM p WHERE term IN (SELECT term FROM q) GROUP BY 1""")
def _postings(spark, d):
    q = table(spark, d, "eval_items").select(F.explode(words("text")).alias("term")).distinct()
    p = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.array_distinct(words("text"))).alias("term"))
    return p.join(maybe_broadcast(q), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n_documents"))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def against(rows: DataFrame, asked: DataFrame, key: str = "query_id") -> DataFrame:
    """All rows with all of a stated query set, which is sent to the tasks in blocks within the size bound."""
    if not small(asked):
        asked = materialize(asked, "query-set")  # from here its true size is known
    n = planned_bytes(asked) // BROADCAST_BYTES + 1
    blocks = [asked] if n == 1 else [asked.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]
    out = rows.crossJoin(F.broadcast(blocks[0]))
    for b in blocks[1:]:
        out = out.unionByName(rows.crossJoin(F.broadcast(b)))
    return out


def exact_search(vectors: DataFrame, every: int, k: int, id_col: str = "vec_id", vec: str = "embedding", cosine: bool = True) -> DataFrame:
    """Exact nearest neighbours of the rows whose id is divisible by ``every``. The k best
    per query are kept in each task before they are shuffled."""
    q = vectors.where((F.col(id_col) % every == 0) & F.col(vec).isNotNull()).select(F.col(id_col).alias("query_id"), F.col(vec).alias("_q"), norm(vec).alias("_nq"))
    x = vectors.where(F.col(vec).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(vec).alias("_x"), norm(vec).alias("_nx"))
    s = dot("_q", "_x")
    score = F.coalesce(F.try_divide(s, F.col("_nq") * F.col("_nx")), F.lit(0.0)) if cosine else s
    pairs = against(x, q).where("query_id <> doc_id").select("query_id", "doc_id", score.alias("score"))
    return ranked(pairs, ["query_id"], by_score(), k)


_DENSE = """WITH q AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id AS doc_id, {s} AS score FROM q, embeddings WHERE vec_id <> query_id)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 10"""
_DOT = "list_sum(list_transform(list_zip(a, embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_NRM = "sqrt(list_sum(list_transform({v}, lambda z: z::DOUBLE * z::DOUBLE)))"


@CAT.query("ret_dense_exact", _DENSE.format(s=f"coalesce({_DOT} / nullif({_NRM.format(v='a')} * {_NRM.format(v='embedding')}, 0), 0)"))
def _dense(spark, d):
    return exact_search(table(spark, d, "embeddings"), 50, 10).withColumn("score", F.round("score", 6))


@CAT.query("join_cross_vector", _DENSE.format(s=_DOT))
def _inner(spark, d):
    return exact_search(table(spark, d, "embeddings"), 50, 10, cosine=False).withColumn("score", F.round("score", 6))


def _sparse(d: DataFrame) -> DataFrame:
    """Positive coordinates as (id, term, weight)."""
    e = d.select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("term", "weight"))
    return e.where("weight > 0").select("id", "term", F.col("weight").cast("double").alias("weight"))


@CAT.query("ret_splade_score", """WITH e AS (SELECT vec_id AS id, unnest(range(64)) AS term, unnest(embedding)::DOUBLE AS weight FROM embeddings), p AS (SELECT * FROM e WHERE weight > 0), s AS (SELECT q.id AS query_id, x.id AS doc_id, sum(q.weight * x.weight) AS score FROM p q JOIN p x ON x.term = q.term AND x.id <> q.id WHERE q.id % 50 = 0 GROUP BY 1, 2)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def _splade(spark, d):
    p = _sparse(table(spark, d, "embeddings"))
    q = p.where("id % 50 = 0").select(F.col("id").alias("query_id"), "term", F.col("weight").alias("qw"))
    s = p.join(maybe_broadcast(q), "term").where("id <> query_id").groupBy("query_id", F.col("id").alias("doc_id")).agg(F.sum(F.col("qw") * F.col("weight")).alias("score"))
    return ranked(s, ["query_id"], by_score(), 10).withColumn("score", F.round("score", 6))


@CAT.query("ret_splade_terms", "WITH e AS (SELECT vec_id AS id, unnest(range(64))::INT AS term, unnest(embedding)::DOUBLE AS weight FROM embeddings) SELECT id, term, round(weight, 6) AS weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(weight, 9) DESC, term) AS rank FROM e WHERE weight > 0) WHERE rank <= 5")
def _terms(spark, d):
    # the vector is one row: its best terms come from sorting the array, without a shuffle
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x, i: F.struct((-F.round(x.cast("double"), 9)).alias("o"), i.alias("term"), x.cast("double").alias("weight"))).alias("v"))
    top = F.slice(F.array_sort(F.filter("v", lambda x: x["weight"] > 0)), 1, 5)
    return e.select("id", F.posexplode(top).alias("r", "x")).select("id", F.col("x.term").alias("term"), F.round("x.weight", 6).alias("weight"), (F.col("r") + 1).alias("rank"))


_CHUNK = "SELECT vec_id AS id, unnest(range(8)) AS t, unnest(list_transform(range(8), lambda i: embedding[i * 8 + 1 : i * 8 + 8])) AS v FROM embeddings"


@CAT.query("ret_colbert_maxsim", f"""WITH e AS ({_CHUNK}), p AS (SELECT q.id AS query_id, x.id AS doc_id, q.t, max(list_sum(list_transform(list_zip(q.v, x.v), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))) AS best FROM e q JOIN e x ON x.id <> q.id WHERE q.id % 50 = 0 GROUP BY 1, 2, 3), s AS (SELECT query_id, doc_id, sum(best) AS score FROM p GROUP BY 1, 2)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 5""")
def _maxsim(spark, d):
    # both levels of the aggregation run inside the row of a pair: nothing is exploded
    tokens = lambda c: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(c, i * 8 + 1, 8))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), tokens(F.col("embedding")).alias("v"))
    q = e.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    inner = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    score = F.aggregate("qv", F.lit(0.0), lambda s, a: s + F.array_max(F.transform("v", lambda b: inner(a, b))))
    p = against(e, q).where("id <> query_id").select("query_id", F.col("id").alias("doc_id"), score.alias("score"))
    return ranked(p, ["query_id"], by_score(), 5).withColumn("score", F.round("score", 6))


_BITS = "SELECT vec_id AS id, list_filter(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN i ELSE -1 END), lambda i: i >= 0) AS b FROM embeddings"


def bits(c: str) -> Column:
    """Positions of the positive coordinates: a fingerprint as a set."""
    return F.filter(F.transform(c, lambda x, i: F.when(x > 0, i).otherwise(-1)), lambda i: i >= 0)


@CAT.query("fn_tanimoto", f"""WITH f AS ({_BITS}) SELECT q.id AS query_id, x.id AS doc_id, round(len(list_intersect(q.b, x.b))::DOUBLE / (len(q.b) + len(x.b) - len(list_intersect(q.b, x.b))), 6) AS tanimoto FROM f q JOIN f x ON x.id <> q.id WHERE q.id % 50 = 0 AND len(list_intersect(q.b, x.b))::DOUBLE / (len(q.b) + len(x.b) - len(list_intersect(q.b, x.b))) >= 0.5""")
def _tanimoto(spark, d):
    f = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), bits("embedding").alias("b"))
    q = f.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("b").alias("qb"))
    both = F.size(F.array_intersect("b", "qb"))
    t = F.try_divide(both.cast("double"), (F.size("b") + F.size("qb") - both).cast("double"))
    return against(f, q).where("id <> query_id").select("query_id", F.col("id").alias("doc_id"), F.coalesce(t, F.lit(0.0)).alias("t")).where("t >= 0.5").select("query_id", "doc_id", F.round("t", 6).alias("tanimoto"))


@CAT.query("ret_chem_hamming", f"""WITH f AS ({_BITS}), s AS (SELECT q.id AS query_id, x.id AS doc_id, 1 - (len(q.b) + len(x.b) - 2 * len(list_intersect(q.b, x.b)))::DOUBLE / 64 AS score FROM f q JOIN f x ON x.id <> q.id WHERE q.id % 50 = 0) SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def _hamming(spark, d):
    f = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), bits("embedding").alias("b"))
    q = f.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("b").alias("qb"))
    s = 1 - (F.size("b") + F.size("qb") - 2 * F.size(F.array_intersect("b", "qb"))) / F.lit(64.0)
    return ranked(against(f, q).where("id <> query_id").select("query_id", F.col("id").alias("doc_id"), s.alias("score")), ["query_id"], by_score(), 10).withColumn("score", F.round("score", 6))


@CAT.query("ret_seq_blast", "SELECT query_id, subject_id, bit_score, rank FROM (SELECT query_id, subject_id, max(bit_score) AS bit_score, row_number() OVER (PARTITION BY query_id ORDER BY max(bit_score) DESC, subject_id) AS rank FROM blast_hits WHERE identity >= 70 AND bit_score >= 0 AND NOT isnan(bit_score) AND query_id IS NOT NULL AND subject_id IS NOT NULL GROUP BY 1, 2) WHERE rank <= 50")
def _blast(spark, d):
    """Hits of at least 70 % identity, the 50 best by bit score per query."""
    b = table(spark, d, "blast_hits").where("identity >= 70 and bit_score >= 0 and not isnan(bit_score) and query_id is not null and subject_id is not null")
    return ranked(b.groupBy("query_id", "subject_id").agg(F.max("bit_score").alias("bit_score")), ["query_id"], [F.desc("bit_score"), F.asc("subject_id")], 50)


@CAT.query("fn_tier_tanimoto", "SELECT CASE WHEN similarity >= 0.85 THEN 3 WHEN similarity >= 0.7 THEN 2 WHEN similarity >= 0.5 THEN 1 ELSE 0 END AS tier, count(*) AS n FROM chemical_hits WHERE similarity BETWEEN 0 AND 1 AND NOT isnan(similarity) GROUP BY 1")
def _tier_t(spark, d):
    s = F.col("similarity")
    return table(spark, d, "chemical_hits").where("similarity between 0 and 1 and not isnan(similarity)").groupBy(tier(s, 0.85, 0.7, 0.5).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def tier(s: Column, a: float, b: float, c: float) -> Column:
    return F.when(s >= a, 3).when(s >= b, 2).when(s >= c, 1).otherwise(0)


@CAT.query("fn_tier_identity", "SELECT CASE WHEN identity >= 90 THEN 3 WHEN identity >= 70 THEN 2 WHEN identity >= 50 THEN 1 ELSE 0 END AS tier, count(*) AS n FROM blast_hits WHERE identity IS NOT NULL GROUP BY 1")
def _tier_i(spark, d):
    return table(spark, d, "blast_hits").where("identity is not null").groupBy(tier(F.col("identity"), 90, 70, 50).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@CAT.query("fn_jaccard", withs("corpus1") + """, w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+')) AS a, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS b FROM corpus1 WHERE title <> '' AND text <> '')
SELECT doc_id, round(len(list_intersect(a, b))::DOUBLE / nullif(len(list_distinct(list_concat(a, b))), 0), 6) AS jaccard, round(len(list_intersect(a, b))::DOUBLE / nullif(len(a), 0), 6) AS coverage FROM w""")
def _jaccard(spark, d):
    w = rel(spark, d, "corpus1").where("title <> '' and text <> ''").select("doc_id", F.array_distinct(words("title")).alias("a"), F.array_distinct(words("text")).alias("b"))
    both = F.size(F.array_intersect("a", "b")).cast("double")
    return w.select("doc_id", F.round(F.try_divide(both, F.size(F.array_union("a", "b")).cast("double")), 6).alias("jaccard"), F.round(F.try_divide(both, F.size("a").cast("double")), 6).alias("coverage"))


@CAT.query("fn_tokenize_ws", "SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''))::INT AS n_tokens FROM documents WHERE text IS NOT NULL")
def _ws(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")).alias("n_tokens"))


@CAT.query("fn_tokenize_vocab", "WITH c AS (SELECT DISTINCT word FROM common_words), w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, count(*) AS n_terms FROM w WHERE length(w) > 2 AND w NOT IN (SELECT word FROM c) GROUP BY 1")
def _vocab(spark, d):
    stop = table(spark, d, "common_words").select(F.col("word").alias("w")).distinct()
    w = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("w"))
    return w.where("length(w) > 2").join(maybe_broadcast(stop), "w", "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"))


@CAT.query("fn_abstract_rebuild", "WITH p AS (SELECT DISTINCT paper_id, regexp_split_to_array(trim(abstract), '\\s+') AS w FROM papers WHERE trim(abstract) <> '') SELECT paper_id, array_to_string(w, ' ') AS abstract FROM p")
def _rebuild(spark, d):
    # the inverted index (word -> positions) and back: rows of (position, word) in one sorted array
    p = table(spark, d, "papers").where("trim(abstract) <> ''").select("paper_id", F.split(F.trim("abstract"), r"\s+").alias("w")).distinct()
    index = p.select("paper_id", F.posexplode("w").alias("pos", "word")).groupBy("paper_id", "word").agg(F.collect_list("pos").alias("at"))
    back = index.select("paper_id", "word", F.explode("at").alias("pos")).groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("s"))
    return back.select("paper_id", F.array_join(F.transform("s", lambda x: x["word"]), " ").alias("abstract"))


@CAT.query("ret_prf", _BM.format(t="documents", q="item_id", s="eval_items").replace("SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (", ", f AS (SELECT query_id, doc_id FROM (").replace("WHERE rank <= 10", "WHERE rank <= 5), x AS (SELECT f.query_id, term, sum(tf) AS n FROM f JOIN tf USING (doc_id) WHERE length(term) > 2 AND term NOT IN (SELECT word FROM common_words) GROUP BY 1, 2), y AS (SELECT x.* FROM x ANTI JOIN q USING (query_id, term)) SELECT query_id, term, n::BIGINT AS n, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, term) AS rank FROM y) WHERE rank <= 10"))
def _prf(spark, d):
    """Ten most frequent further terms of the five best documents of each item."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    items = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "text")
    top = bm25_top(docs, items, 5).select("query_id", "doc_id")
    stop = table(spark, d, "common_words").select(F.col("word").alias("term")).distinct()
    terms = top.join(docs, "doc_id").select("query_id", F.explode(words("text")).alias("term")).where("length(term) > 2").join(maybe_broadcast(stop), "term", "left_anti")
    own = items.select("query_id", F.explode(words("text")).alias("term")).distinct()
    n = terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("n")).join(own, ["query_id", "term"], "left_anti")
    return ranked(n, ["query_id"], [F.desc("n"), F.asc("term")], 10)


# --- further scorers -------------------------------------------------------------------------

_WS = "list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda x: x <> '')"
_TOP10 = " SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM b) WHERE rank <= 10"
_LEX = withs("corpus1", "q1") + f""", d AS (SELECT doc_id, {_WS.format(c="coalesce(title, '') || ' ' || coalesce(text, '')")} AS w FROM corpus1), n AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), q AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({_WS.format(c="text")}) AS term FROM q1) GROUP BY 1, 2)"""
_TFW = "qf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25 + 0.75::DOUBLE * dl / avgdl))"


def titled(corpus: DataFrame) -> DataFrame:
    """(doc_id, text): title, a blank and text."""
    return corpus.select("doc_id", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))


def _lexical(name: str, sql: str, idf: str):
    @CAT.query(name, _LEX + sql + _TOP10)
    def _f(spark, d):
        top = bm25_best(titled(rel(spark, d, "corpus1")), rel(spark, d, "q1").select("query_id", "text"), 10, tokens=ws_tokens, idf=idf)
        return top.withColumn("score", F.round("score", 6))


_lexical("ret_bm25_okapi", f", r AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS x FROM df, n), i AS (SELECT term, CASE WHEN x < 0 THEN 0.25::DOUBLE * (SELECT avg(x) FROM r) ELSE x END AS idf FROM r), b AS (SELECT query_id, doc_id, sum(idf * {_TFW}) AS score FROM q JOIN tf USING (term) JOIN i USING (term), n GROUP BY 1, 2)", "okapi")
_lexical("ret_bm25_demo", f", b AS (SELECT query_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * {_TFW}) AS score FROM q JOIN tf USING (term) JOIN df USING (term), n GROUP BY 1, 2)", "lucene")


@CAT.query("ret_idf_sum", _LEX + ", s AS (SELECT query_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1)) AS x FROM q JOIN tf USING (term) JOIN df USING (term), n GROUP BY 1, 2), b AS (SELECT query_id, doc_id, x / max(x) OVER (PARTITION BY query_id) AS score FROM s)" + _TOP10)
def _idf_sum(spark, d):
    """Sum of the idf of shared terms as a share of the best document's. The best is the first of the ranking, so no second pass is needed."""
    top = bm25_best(titled(rel(spark, d, "corpus1")), rel(spark, d, "q1").select("query_id", "text"), 10, tokens=ws_tokens, idf="sum")
    best = F.max("score").over(Window.partitionBy("query_id"))
    return top.withColumn("score", F.round(F.col("score") / best, 6))


_EMB = "coalesce({dot} / nullif({na} * {nb}, 0), 0)".format(dot=_DOT, na=_NRM.format(v="a"), nb=_NRM.format(v="embedding"))


@CAT.query("ret_chem_faiss", "SELECT * FROM (" + _DENSE.format(s=_EMB) + ") WHERE score >= 0.2")
def _chem(spark, d):
    """Nearest by cosine with a least similarity."""
    return exact_search(table(spark, d, "embeddings"), 50, 10).withColumn("score", F.round("score", 6)).where("score >= 0.2")


@CAT.query("ret_seq_embed", f"""WITH m AS (SELECT vec_id, list_transform(range(16), lambda i: (embedding[i * 4 + 1]::DOUBLE + embedding[i * 4 + 2] + embedding[i * 4 + 3] + embedding[i * 4 + 4]) / 4) AS embedding FROM embeddings) {_DENSE.format(s=_EMB).replace("WITH q AS", ", q AS").replace("FROM embeddings", "FROM m").replace("FROM q, embeddings", "FROM q, m")}""")
def _seq(spark, d):
    """Cosine of pooled token vectors: runs of four coordinates stand for a sequence's tokens, their means for the pooled vector."""
    pooled = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.aggregate(F.slice("embedding", i * 4 + 1, 4), F.lit(0.0), lambda s, x: s + x.cast("double")) / 4)
    return exact_search(table(spark, d, "embeddings").select("vec_id", pooled.alias("embedding")), 50, 10).withColumn("score", F.round("score", 6))


@CAT.query("ret_colbert_cand", f"""WITH e AS ({_CHUNK}), s AS (SELECT q.id AS query_id, q.t, x.id AS doc_id, x.t AS u, list_sum(list_transform(list_zip(q.v, x.v), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS score FROM e q JOIN e x ON x.id <> q.id WHERE q.id % 50 = 0),
n AS (SELECT query_id, doc_id FROM s QUALIFY row_number() OVER (PARTITION BY query_id, t ORDER BY round(score, 9) DESC, doc_id, u) <= 40), v AS (SELECT query_id, doc_id, count(*) AS votes FROM n GROUP BY 1, 2) SELECT query_id, doc_id, votes, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, doc_id) AS rank FROM v) WHERE rank <= 10""")
def _colbert(spark, d):
    """Candidates by votes: each query token's 40 nearest document tokens vote for their documents, the ten with most votes stay."""
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct(i.alias("t"), F.slice("embedding", i * 8 + 1, 8).alias("v")))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.inline(tokens))
    q = e.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("t").alias("qt"), F.col("v").alias("qv"))
    near = against(e, q).where("id <> query_id").select("query_id", "qt", F.col("id").alias("doc_id"), "t", dot("qv", "v").alias("score"))
    votes = ranked(near, ["query_id", "qt"], [F.round("score", 9).desc(), F.asc("doc_id"), F.asc("t")], 40).groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("votes"))
    return ranked(votes, ["query_id"], [F.desc("votes"), F.asc("doc_id")], 10)


@CAT.query("fus_hybrid", _LEX + f", l0 AS (SELECT query_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * {_TFW}) AS score FROM q JOIN tf USING (term) JOIN df USING (term), n GROUP BY 1, 2), l AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM l0 QUALIFY r <= 20), " + withs("scored")[5:] + ", g AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(avg(score), 9) DESC, doc_id) AS r FROM scored GROUP BY 1, 2 QUALIFY r <= 20), b AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + r)) AS score FROM (SELECT * FROM l UNION ALL SELECT * FROM g) GROUP BY 1, 2)" + _TOP10)
def _hybrid(spark, d):
    """Lexical search and a second scorer, twice as deep as asked for, fused by reciprocal rank and cut. The judges' mean score stands for the encoder's."""
    lexical = bm25_best(titled(rel(spark, d, "corpus1")), rel(spark, d, "q1").select("query_id", "text"), 20, tokens=ws_tokens)
    other = ranked(rel(spark, d, "scored").groupBy("query_id", "doc_id").agg(F.avg("score").alias("score")), ["query_id"], by_score(), 20)
    both = lexical.select("query_id", "doc_id", "rank").unionByName(other.select("query_id", "doc_id", "rank"))
    fused = both.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (F.lit(60.0) + F.col("rank"))).alias("score"))
    return ranked(fused, ["query_id"], by_score(), 10).withColumn("score", F.round("score", 6))


#: The inverted-file index: rows its centroids are fitted on at most, rows per centroid, share of the lists probed.
IVF_SAMPLE, IVF_LIST, IVF_PROBED = 20_000, 200, 0.75


def inverted_file(vectors: DataFrame, seed: int = 42, id_col: str = "vec_id", vec: str = "embedding"):
    """(centroids, rows with their list): k-means centroids fitted on a bounded sample of unit vectors;
    every row is indexed, in the list of its nearest centroid."""
    x = vectors.where(F.col(vec).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec).alias("v"))
    n = x.count()
    sample = x.select("v").sample(min(1.0, IVF_SAMPLE / max(1, n)), seed).limit(IVF_SAMPLE)
    a = np.array([r[0] for r in sample.collect()], dtype=float)
    if not len(a):
        return np.empty((0, 1)), x.withColumn("list", F.lit(0))
    a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
    k = max(1, min(1024, len(a), n // IVF_LIST))
    c = a[np.random.RandomState(seed).permutation(len(a))[:k]]
    for _ in range(10):
        at = (a @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, a)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 0, sums / np.maximum(norms, 1e-12), c)

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series((np.stack(v.to_numpy()).astype(float) @ c.T).argmax(axis=1))

    return c, x.withColumn("list", nearest("v"))


def approximate_search(vectors: DataFrame, every: int, k: int, probed: float = IVF_PROBED) -> DataFrame:
    """Nearest neighbours by cosine among the rows of the lists nearest to the query; the join is on the list."""
    c, rows = inverted_file(vectors)
    m = max(1, int(np.ceil(probed * len(c))))

    @F.pandas_udf("array<int>")
    def lists(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.argsort(-(np.stack(v.to_numpy()).astype(float) @ c.T), axis=1)[:, :m].astype(int)))

    q = rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.col("v").alias("qv"), F.explode(lists("v")).alias("list"))
    s = F.coalesce(F.try_divide(dot("qv", "v"), norm("qv") * norm("v")), F.lit(0.0))
    pairs = rows.join(maybe_broadcast(q), "list").where("id <> query_id").select("query_id", F.col("id").alias("doc_id"), s.alias("score"))
    return ranked(pairs, ["query_id"], by_score(), k)


@CAT.query("ret_dense_ann")
def _ann(spark, d):
    return approximate_search(table(spark, d, "embeddings"), 50, 10).withColumn("score", F.round("score", 6))
