"""Evaluation texts that leak into training text.

1. Texts are normalised: markup, entities, typographic variants, hyphenation at
   line ends and inserted reference marks go; lower-cased words remain.
2. Windows sized by the item: a passage may be a third of an item in two
   stretches, so its longer stretch holds a sixth of the item's words, and with
   single words changed a twelfth of them in a row. An item of n words is
   therefore indexed by windows of n / 12 words, rounded down to one of
   ``SIZES`` (the whole item if it is shorter than the least of them). Every
   window of these sizes, of items and documents, gets a 64-bit SimHash.
3. The windows of the items are indexed by four blocks of 16 bits. Two
   fingerprints within ``RADIUS`` = 3 bits agree in at least one block, so the
   index finds every one. Windows that many items share are stock phrases and
   no seeds (unless an item has no others).
4. Each (document, item) with seeds is verified exactly: shingles of two words
   that both hold are chained in the order of either text (``chains``), words
   weighing by their frequency over all items, and a chain is a stretch if the
   weighted shingles in it reach ``SIMILARITY`` of the item's there. Stock
   sentences filled otherwise don't: their shared words weigh nothing. The
   pair is a case if the best one or two stretches in order hold at least
   ``SHARE`` of the item's words.

What many items share (words, windows) is counted over all items, in Spark, and
only what is shared is gathered: at most a hundred times the words of an
average item, however many items there are. The items are the stated query
set: they go to the tasks in blocks of at most ``BLOCK_WORDS`` words, one pass
over the documents per block, so the driver holds one block's texts at a time
when there are several; answers don't depend on the blocks. Nothing is shuffled
but the result. A document is read whole, whatever its length. All texts of a
batch are normalised and fingerprinted together, as columns.

Defined cases: null, blank and wordless texts give nothing; repeated documents
give a row each; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import materialize
from ..sources.tables import table

SIZES = (5, 8, 13, 21, 34, 55, 89)
RADIUS = 3
SHARE = 1 / 3
#: Share of the weight of an item's shingles, within a stretch, that the document must hold too.
SIMILARITY = 0.6
#: A word or window of more than this share of the items (and of more than two) is common.
COMMON_SHARE = 0.01
#: Gains and losses of words in a chain: distinctive, common; of each inserted or left out word; least chain.
GAIN, GAIN_COMMON, GAP, LEAST = 1.5, 0.8, 0.7, 4.0
BLOCK_WORDS = 400_000
CHUNK_BYTES = 4 << 20
PIECE = 200_000

_TAGS = re.compile(r"<sup>\s*\d+\s*</sup>|<sub>\s*\d+\s*</sub>|<[^<>]{1,200}>", re.I)
_SQUARE = re.compile(r"\[\s*\d+\s*\]")
_ROUND = re.compile(r"\((?<!\w\()\s*\d+\s*\)(?!\w)")
_BREAKS = re.compile(r"-(?<=[^\W\d_]-)\s*\n\s*(?=[^\W\d_])")
_GONE = re.compile("[­​-‏⁠﻿]")


def _cleaned(text: str) -> str:
    if "<" in text:
        text = _TAGS.sub(" ", text)
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _GONE.sub("", text)).replace("\u2010", "-")
    if "[" in text:
        text = _SQUARE.sub(" ", text)
    if "(" in text:
        text = _ROUND.sub(" ", text)
    return _BREAKS.sub("", text) if "\n" in text else text


def words_of(texts: list[str]) -> tuple[np.ndarray, pa.Array]:
    """The words of all texts in one row, and where each text's words begin (and the last end)."""
    plain = pc.utf8_lower(pa.array([_cleaned(t) for t in texts], pa.large_string()))
    lists = pc.split_pattern(pc.utf8_trim(pc.replace_substring_regex(plain, r"[^\pL\pN]+", " "), " "), " ")
    words = pc.list_flatten(lists)
    some = np.asarray(pc.binary_length(words)) > 0  # a text without words is one empty string
    ends = np.concatenate([[0], np.cumsum(some)])[np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))])]
    return ends, words.filter(pa.array(some))


def normalised(text: str) -> list[str]:
    return words_of([text])[1].to_pylist()


def window_size(n: int) -> int:
    """Words of the windows of an item of n words."""
    return min(n, max((s for s in SIZES if s * 12 <= n), default=SIZES[0]))


def hashed(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code of each word, 64-bit hash per code)."""
    d = pc.dictionary_encode(words)
    return np.asarray(d.indices).astype(np.int64), np.array([xxhash.xxh64_intdigest(w, seed=11) for w in d.dictionary.to_pylist()], dtype=np.uint64)


def simhashes(bits: np.ndarray, window: int) -> np.ndarray:
    """SimHash of every window of ``window`` words, given the words' hashes: each bit is set
    if it is in more than half of them. The 64 counts are kept as planes of their binary digits."""
    m = len(bits) - window + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    planes: list[np.ndarray] = []
    for k in range(window):
        carry = bits[k : k + m]
        for p, x in enumerate(planes):
            planes[p], carry = x ^ carry, x & carry
        if k + 1 >= 1 << len(planes):
            planes.append(carry.copy())
    least = window // 2 + 1
    over, equal = np.zeros(m, np.uint64), np.full(m, ~np.uint64(0))
    for p in range(len(planes) - 1, -1, -1):
        if least >> p & 1:
            equal &= planes[p]
        else:
            over |= equal & planes[p]
            equal &= ~planes[p]
    return over | equal


class ItemIndex:
    """Fingerprints of the items' windows by size and blocks of bits, and what verification
    needs. ``weights``: common words of all items with their weights, the others weigh 1;
    ``stock``: fingerprints of windows that many items share."""

    def __init__(self, items: list[tuple[int, str]], weights: dict[str, float], stock: np.ndarray):
        ends, words = words_of([t for _, t in items])
        some = np.flatnonzero(np.diff(ends) > 0)
        self.ids = [items[k][0] for k in some]
        code, bits = hashed(words)
        names = words.to_pylist()
        self.items = [names[ends[k] : ends[k + 1]] for k in some]
        self.weight = [np.array([weights.get(w, 1.0) for w in ws]) for ws in self.items]
        self.length = np.array([len(ws) for ws in self.items])
        self.plain = np.array([not (w >= 1).any() for w in self.weight])
        found = defaultdict(lambda: ([], [], []))
        for n, k in enumerate(some):
            size = window_size(len(self.items[n]))
            hs = simhashes(bits[code[ends[k] : ends[k + 1]]], size)
            rare = np.flatnonzero(~np.isin(hs, stock))
            rare = rare if len(rare) else np.arange(len(hs))
            for got, x in zip(found[size], (hs[rare], np.full(len(rare), n), rare)):
                got.append(x)
        self.by_size = {}
        self.windows = {}
        for size, parts in found.items():
            prints, owner, place = map(np.concatenate, parts)
            heavy = [np.convolve(w >= 1, np.ones(size, int), "valid") if len(w) >= size else np.zeros(1, int) for w in self.weight]
            self.windows[size] = np.array([heavy[k][p] if len(self.weight[k]) >= size else 0 for k, p in zip(owner, place)])
            blocks = []
            for b in range(4):
                part = (prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)
                order = np.argsort(part, kind="stable").astype(np.int32)
                blocks.append((order, np.searchsorted(part[order], np.arange(65537, dtype=np.uint64))))
            self.by_size[size] = prints, owner, place, blocks

    def seeds(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(document window, index entry) of all pairs within the radius."""
        prints, _, _, blocks = self.by_size[size]
        at, entry = [], []
        for b, (order, starts) in enumerate(blocks):
            part = ((hashes >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            lo, n = starts[part], starts[part + 1] - starts[part]
            some = np.flatnonzero(n)
            for c in range(0, len(some), PIECE):
                s = some[c : c + PIECE]
                m = n[s]
                i = np.repeat(s, m)
                e = order[np.repeat(lo[s], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
                ok = np.bitwise_count(hashes[i] ^ prints[e]) <= RADIUS
                at.append(i[ok]), entry.append(e[ok])
        if not at:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(at), np.concatenate(entry)

    def promising(self, k: int, places: np.ndarray, size: int, share: float) -> bool:
        """Cheap bound before the verification: the item's words under met windows must be a
        third of the share asked for, and two of them distinctive. Every run of unchanged
        words as long as the window is such a window."""
        item, heavy = self.items[k], self.weight[k] >= 1
        under = {p + s for p in places.tolist() for s in range(size)}
        return len(under) >= share * len(item) / 3 and (not heavy.any() or len({item[p] for p in under if heavy[p]}) >= min(2, heavy.sum()))

    def covered(self, k: int, doc: list[str], places: np.ndarray) -> float:
        """Share of item k's words that the document reproduces in one or two stretches
        in the item's order; ``places``: where its windows were met."""
        item, weight = self.items[k], self.weight[k]
        n = len(item)
        regions: list[list[int]] = []
        for p in np.unique(places):
            lo, hi = max(0, int(p) - n - 10), int(p) + n + 10
            if regions and lo <= regions[-1][1]:
                regions[-1][1] = hi
            else:
                regions.append([lo, hi])
        found = [(a, z, c + lo, d + lo) for lo, hi in regions for a, z, c, d in stretches(item, weight, doc[lo:hi])]
        best = 0
        for i, (a, z, c, d) in enumerate(found):
            best = max(best, z - a + 1)
            for a2, z2, c2, d2 in found[i + 1 :]:
                if z < a2 and d < c2 or z2 < a and d2 < c:
                    best = max(best, z - a + z2 - a2 + 2)
        return best / n


def chains(item: list[str], weight: np.ndarray, doc: list[str]) -> Iterator[tuple[list[int], list[int]]]:
    """Chains of words, in the order of both texts, that stand in shingles both hold; the best
    first, each without the words of the document that the ones before took. A chain gains by
    its words and loses by those of the item it leaves out and by shifts between the texts."""
    where = defaultdict(list)
    for i, w in enumerate(item):
        where[w].append(i)
    near = min(2, len(item))
    hits = set()
    for j in range(len(doc) - near + 1):
        for i in where.get(doc[j], ()):
            if i + near <= len(item) and item[i : i + near] == doc[j : j + near]:
                hits.update((i + s, j + s) for s in range(near))
    cells = sorted(hits, key=lambda x: (x[1], x[0]))
    if not cells:
        return
    i, j = np.array(cells).T
    heavy = weight >= 1
    gain = np.where(heavy, GAIN, GAIN_COMMON)
    lost = np.concatenate([[0.0], np.cumsum(np.minimum(gain, 2 * GAP))])
    reach = int(sum(gain) / min(GAP, GAIN_COMMON)) + 1  # a longer gap costs more than the item can gain
    free = np.ones(len(i), bool)
    while free.any():
        at = np.flatnonzero(free)
        x, y = i[at], j[at]
        score, back = gain[x].copy(), np.full(len(at), -1)
        first = np.searchsorted(y, y - reach)
        last = np.searchsorted(y, y)
        for t in range(len(at)):
            lo, hi = first[t], last[t]
            if lo < hi:
                px, py = x[lo:hi], y[lo:hi]
                skipped, shift = x[t] - px - 1, (x[t] - px) - (y[t] - py)
                # substituted words cost their loss once, shifted ones a gap each
                cost = np.where(shift >= 0, lost[x[t]] - lost[np.minimum(px + 1 + np.maximum(shift, 0), x[t])] + GAP * shift, lost[x[t]] - lost[px + 1] - GAP * shift)
                got = np.where(skipped >= 0, score[lo:hi] - cost, -1.0)
                b = int(got.argmax())
                if got[b] > 0:
                    score[t], back[t] = score[t] + got[b], lo + b
        t = int(score.argmax())
        if score[t] < LEAST:
            return
        chain = []
        while t >= 0:
            chain.append(t)
            t = int(back[t])
        chain.reverse()
        yield x[chain].tolist(), y[chain].tolist()
        free[at[(y >= y[chain[0]]) & (y <= y[chain[-1]])]] = False


def stretches(item: list[str], weight: np.ndarray, doc: list[str]) -> list[tuple[int, int, int, int]]:
    """(first, last word of the item, first, last word of the document) of every chain whose
    shingles reach ``SIMILARITY`` of the weight of the item's between its ends."""
    out = []
    for x, y in chains(item, weight, doc):
        a, z = x[0], x[-1]
        inside = weight[a : z + 1]
        if len(x) >= min(SIZES[0], len(item)) and weight[x].sum() >= SIMILARITY * inside.sum():
            out.append((a, z, y[0], y[-1]))
    return out


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for k, t in enumerate(texts):
        if k > lo and size + len(t) > CHUNK_BYTES:
            yield lo, k
            lo, size = k, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def scanned(index: ItemIndex, texts: list[str], share: float) -> Iterator[tuple[int, int, float]]:
    """(text, item, share reproduced) of the texts' leaks."""
    ends, words = words_of(texts)
    code, bits = hashed(words)
    bits = bits[code]
    owner = np.repeat(np.arange(len(texts)), np.diff(ends))
    for size, (_, items, places, _) in index.by_size.items():
        prints = simhashes(bits, size)
        within = np.flatnonzero(owner[: len(prints)] == owner[size - 1 :][: len(prints)])
        at, entry = index.seeds(prints[within], size)
        if not len(at):
            continue
        at = within[at]
        order = np.lexsort((items[entry], owner[at]))
        at, entry = at[order], entry[order]
        d, k = owner[at], items[entry]
        cuts = np.flatnonzero(np.r_[True, (np.diff(d) != 0) | (np.diff(k) != 0)])
        # what no set of places can make up for: too few windows, or none with a distinctive word
        enough = np.diff(np.append(cuts, len(at))) * size * 3 >= share * index.length[k[cuts]]
        enough &= (np.add.reduceat(index.windows[size][entry], cuts) > 0) | index.plain[k[cuts]]
        for lo, hi in zip(cuts[enough], np.append(cuts[1:], len(at))[enough]):
            doc, item = int(d[lo]), int(k[lo])
            if index.promising(item, np.unique(places[entry[lo:hi]]), size, share):
                start = int(ends[doc])
                got = index.covered(item, words[start : int(ends[doc + 1])].to_pylist(), at[lo:hi] - start)
                if got >= share:
                    yield doc, index.ids[item], min(1.0, got)


def _scan(index: ItemIndex, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for lo, hi in _chunks(texts):
                got = list(scanned(index, texts[lo:hi], share))
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([ids[lo + d] for d, _, _ in got], pa.int64()), "item_id": pa.array([k for _, k, _ in got], pa.int64()), "share": pa.array([s for *_, s in got], pa.float64())})

    return run


def _elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct words and windows of each item, and its number of words."""
    for p in batches:
        rows = []
        for text in p["text"]:
            _, words = words_of([text])
            code, bits = hashed(words)
            if len(code):
                rows.append((None, None, len(code)))
                rows.extend((w, None, 0) for w in set(words.to_pylist()))
                rows.extend((None, int(h), 0) for h in np.unique(simhashes(bits[code], window_size(len(code)))).view(np.int64))
        yield pd.DataFrame({"word": pd.Series([r[0] for r in rows], dtype=object), "print": pd.Series([r[1] for r in rows], dtype="Int64"), "n": pd.Series([r[2] for r in rows], dtype="int64")})


def shared_by_items(items: DataFrame) -> tuple[dict[str, float], np.ndarray]:
    """(weights of the words that many items hold, windows that many items hold), counted over
    all items. At most 1 / COMMON_SHARE times an average item's words are gathered."""
    found = items.mapInPandas(_elements, "word string, print bigint, n bigint")
    held = materialize(found.groupBy("word", "print").agg(F.count("*").alias("k")), "leak-elements")
    n = held.where("word is null and print is null").agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    many = held.where(F.col("k") > max(2, n * COMMON_SHARE)).where("word is not null or print is not null").toLocalIterator()
    weights, stock = {}, []
    for r in many:
        if r.word is not None:
            weights[r.word] = 0.0
        else:
            stock.append(r.print)
    return weights, np.array(stock, dtype=np.int64).view(np.uint64)


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    block: list[tuple[int, str]] = []
    size = 0
    for r in items.orderBy("item_id").toLocalIterator():
        n = len(r[1]) // 4 + 1
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame, share: float = SHARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, share) for documents (doc_id, text) and items (item_id, text). The
    items are counted and read when this is called; one block of them stays lazy, several
    are written one after another."""
    slim = docs.select("doc_id", "text").where("doc_id is not null and text is not null and trim(text) <> ''")
    given = items.select("item_id", "text").where("item_id is not null and trim(text) <> ''")
    weights, stock = shared_by_items(given)
    out, before = None, None
    for block in _blocks(given, block_words):
        if before is not None:
            part = materialize(before, "leaks")
            out = part if out is None else out.unionByName(part)
        before = slim.mapInArrow(_scan(ItemIndex(block, weights, stock), share), "doc_id bigint, item_id bigint, share double")
    if before is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, share double")
    return before if out is None else out.unionByName(materialize(before, "leaks"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the items of which they reproduce at least a third."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items: documents concerned and the largest share reproduced."""
    per = _leaks(spark, sf_dir).groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_documents"), F.max("share").alias("largest_share"))
    return per.join(table(spark, sf_dir, "eval_items").select("item_id", "suite", "split"), "item_id").select("item_id", "suite", "split", "n_documents", "largest_share")


def queries():
    return {"p9_found": p9_found, "p9_items": p9_items}


def oracle_sql():
    return {}
