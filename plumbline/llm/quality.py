"""Per-document text statistics, and rules that tell prose from lists, tables and junk.

``statistics`` computes whole-document figures with JVM expressions: words,
mean word length, shares of symbols, digits, bullet lines, lines that end in
punctuation, alphabetic and common words, repeated lines. ``failures`` applies
published fixed thresholds to them and records a reason per failed rule.

Those rules judge a document as a whole. Whether more than half of its
characters are running sentences is decided by the same statistics on its
parts: ``part_statistics`` cuts texts into lines, joined where a sentence runs
on, and those into sentences, and computes length, letters, symbols,
punctuation, bullets, delimiters and common words of all parts of a batch at
once, as columns; ``part_failures`` applies fixed thresholds and records the
reason of each failing part. ``prose_share`` sums both per document. No text is
visited by itself: everything runs on Arrow and numpy columns. No language is
assumed: the common words of all languages given are used together.

Defined cases: null text gives null statistics and no verdict; blank text has
zero words, fails ``word_count`` and is no case; documents are read whole, a
batch is cut between documents only.
"""

from __future__ import annotations

import functools
import html
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

#: Published whole-document thresholds (fixed values): word count, mean word length, symbols to
#: words, share of bullet lines, share of lines ending in an ellipsis, share of words with a
#: letter, common words present, share of characters in repeated lines.
MIN_WORDS, MAX_WORDS = 50, 100_000
MIN_MEAN_LENGTH, MAX_MEAN_LENGTH = 3.0, 10.0
MAX_SYMBOL_RATIO = 0.1
MAX_BULLET_LINES = 0.9
MAX_ELLIPSIS_LINES = 0.3
MIN_ALPHA_WORDS = 0.8
MIN_COMMON_WORDS = 2
MAX_REPEATED_LINES = 0.3

#: Texts of a batch are worked on together up to this many bytes; one longer text by itself.
CHUNK_BYTES = 4 << 20

#: Fixed thresholds on parts: a line under SHORT characters may be a menu entry, one of WRAPPED or
#: more runs on into the next; letters of a closed and of an open sentence; words of a closed and of
#: an open one; common words and commas of an open one; repetitions; symbols and encoding damage.
SHORT, WRAPPED = 60, 45
MIN_LETTERS_CLOSED, MIN_LETTERS_OPEN = 0.33, 0.45
MIN_WORDS_CLOSED, MIN_WORDS_OPEN = 3, 9
MIN_COMMON_OPEN, MAX_COMMAS_OPEN = 0.12, 0.3
REPEATS = 3
MAX_SYMBOLS, MAX_DAMAGE = 0.08, 0.03
MENU_LINES, MENU_OPEN = 4, 0.3
SALAD_ARTICLES, MAX_SALAD = 3, 0.15

#: Words after which a noun phrase must go on (fixed values).
ARTICLES = ("the", "a", "an", "der", "die", "das", "den", "dem", "des", "ein", "eine", "einen", "einem", "einer", "le", "la", "les", "un", "une")
#: Common words that may follow an article (fixed values).
AFTER_ARTICLE = ("first", "one", "two", "most", "more", "other", "only", "further", "so", "such", "all", "both", "plus", "été")
#: Characters that wrongly decoded text is full of, and those that prose may hold besides letters and digits (fixed values).
DAMAGE = "ÂÃ€™œ¢§¶\ufffd©¤¬¦¨¯´¸ð¿¡"
PLAIN = " .,;:'\"()/-–—°%µμ’‘“”„!?[]+±×·&\n\t"

REASONS = ("", "symbols", "log", "markup", "table", "leaders", "references", "codes", "repeated", "menu", "encoding", "salad", "digits", "fragment", "bullets")
_CODE = {r: k for k, r in enumerate(REASONS)}

_BULLET = r"^\s*(?:[-*•–—·‣◦]|\(?\d{1,4}[.)\]]|\[\d{1,5}\]|\(?[a-z][.)])\s+"
_END = r"[.!?…][\"'”’»)\]]*$"
#: Reasons why one line by itself is no prose, the first that holds.
_LINE_RULES = (
    ("symbols", r"^[-=_*~.#+|\s]+$"),
    ("log", r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d"),
    ("markup", r"(?i)</?(?:td|tr|table|li|ul|div|th)\b"),
    ("markup", r"^(?:[{\[].*[\"']\s*:|<[^>]+>$)"),
    ("table", r"\t.*\t|\|.*\||\S(?: {2,}|\t)\S.*\S(?: {2,}|\t)\S"),
    ("leaders", r"(?:\.\s?){5,}\s*\d*$"),
    ("references", r"^\[\d+\].*\(\d{4}\)\.?$"),
    ("codes", r"^\d+(?: [a-z]{1,10}){2,6}$|^(?:[acgtun]{10} ?){2,}[acgtun]*$|^>\S*$|^\S{25,}$"),
)


@functools.cache
def _classes() -> np.ndarray:
    """Bits of each character: 1 letter, 2 symbol, 4 sign of damage, 8 comma or semicolon."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for k in range(0x30000):
        c = chr(k)
        out[k] = c.isalpha() | (not (c.isalnum() or c in PLAIN)) << 1 | (c in DAMAGE) << 2 | (c in ",;") << 3
    return out


def _cleaned(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.replace("\u00ad", "").replace("\u200b", ""))
        if "\ufffd" in text or "Ã" in text:
            text = text.replace("\r", "\n")
    return html.unescape(text) if "&" in text else text


def _np(x) -> np.ndarray:
    return np.asarray(x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x)


def _hits(strings: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(strings, pattern).to_numpy(zero_copy_only=False).astype(bool)


def _count(strings: pa.Array, bits: tuple[int, ...]) -> list[np.ndarray]:
    """Characters of each string that are of each class."""
    n = _np(pc.utf8_length(strings)).astype(np.int64)
    data = "".join(strings.to_pylist()).encode("utf-32-le", "surrogatepass")
    kinds = _classes()[np.frombuffer(data, dtype=np.uint32)]
    ends = np.cumsum(n)
    out = []
    for b in bits:
        sums = np.concatenate([[0], np.cumsum((kinds & b) > 0, dtype=np.int64)])
        out.append(sums[ends] - sums[ends - n])
    return out


def _held(owner: np.ndarray, strings: pa.Array, of: np.ndarray) -> np.ndarray:
    """How often each string's letters and digits occur in its owner, among the strings of ``of``."""
    plain = pc.utf8_lower(pc.utf8_trim_whitespace(pc.replace_substring_regex(strings, r"[^\pL\pN_]+", " ")))
    code = _np(pc.dictionary_encode(plain).indices).astype(np.int64)
    key = owner.astype(np.int64) * (int(code.max(initial=0)) + 1) + code
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    return np.bincount(at, weights=of, minlength=len(n))[at] if len(key) else np.zeros(0)


def _split(owner: np.ndarray, strings: pa.Array, pattern: str) -> tuple[np.ndarray, pa.Array]:
    lists = pc.split_pattern(strings, pattern)
    return np.repeat(owner, _np(pc.list_value_length(lists))), pc.list_flatten(lists)


def _pick(strings: pa.Array, mask: np.ndarray) -> pa.Array:
    return strings.filter(pa.array(mask))


def part_statistics(texts: list[str], common: pa.Array) -> dict[str, np.ndarray]:
    """Columns over all parts of the texts (lines that are no prose by themselves, damaged
    paragraphs, and sentences): ``doc`` (which text), ``n`` (characters), ``why`` (reason
    already given by the part's line or paragraph, or 0), ``letters``, ``words``,
    ``common``, ``commas``, ``ended``, ``bullet``, ``menu``, and the texts themselves."""
    doc, lines = _split(np.arange(len(texts)), pa.array([_cleaned(t) for t in texts], pa.large_string()), "\n")
    body = pc.utf8_trim_whitespace(lines)
    n = _np(pc.utf8_length(body)).astype(np.int64)
    full = n > 0
    gap = np.diff(np.flatnonzero(full), prepend=-2) > 1  # a blank line stands before
    doc, lines, body, n = doc[full], _pick(lines, full), _pick(body, full), n[full]
    why = np.zeros(len(n), np.int8)
    for reason, pattern in reversed(_LINE_RULES):
        why[_hits(body, pattern)] = _CODE[reason]
    bare_commas = _np(pc.count_substring_regex(body, r"[^\s,],")) >= 3
    why[(why == 0) & bare_commas & ~_hits(body, ", ")] = _CODE["table"]
    why[(why == 0) & _hits(body, r"\S{46,}") & ~_hits(body, r"https?://")] = _CODE["codes"]
    why[(why == 0) & (_held(doc, body, np.ones(len(n))) >= REPEATS)] = _CODE["repeated"]
    ended, bullet = _hits(body, _END), _hits(lines, _BULLET)

    # lines run on into paragraphs
    tail = pc.replace_substring_regex(pc.utf8_lower(pc.utf8_slice_codeunits(body, -20, None)), r"[^\pL]+$", "")
    tail = pc.replace_substring_regex(tail, r"^.*[^\pL]", "")
    open_ = _hits(body, r"[,;\-]$") | (n >= WRAPPED) | _np(pc.is_in(tail, common))
    on = np.zeros(len(n), bool)
    if len(n):
        last = slice(None, -1)
        lower = _hits(body, r"^(?:\p{Ll}|\pN)")
        on[1:] = np.where(ended[last], n[last] >= WRAPPED, lower[1:] | open_[last])
        on[1:] &= ~bullet[1:] & (why[1:] == 0) & (why[last] == 0) & (doc[1:] == doc[last]) & ~gap[1:]
    first = np.flatnonzero(~on)
    units = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(first, len(n)), pa.int32()), body), pa.scalar(" ", body.type)) if len(n) else body
    u_doc, u_why, u_ended = doc[first], why[first], ended[first]
    size = np.diff(np.append(first, len(n)))
    u_n = _np(pc.utf8_length(units)).astype(np.int64)

    # short lines by themselves, one after another
    short = (size == 1) & (u_n < SHORT) & ((u_why == 0) | (u_why == _CODE["repeated"]))
    starts = np.ones(len(first), bool)
    starts[1:] = ~(short[1:] & short[:-1]) | gap[first][1:] | (u_doc[1:] != u_doc[:-1])
    seg = np.cumsum(starts) - 1
    many, left_open = np.bincount(seg), np.bincount(seg, weights=~u_ended)
    menu = short & ((many >= MENU_LINES) & (left_open >= MENU_OPEN * many))[seg] if len(seg) else short

    # paragraphs that are damaged as a whole
    bare = pc.replace_substring_regex(units, _BULLET, "")
    symbols, damage = _count(bare, (2, 4))
    b_n = _np(pc.utf8_length(bare)).astype(np.int64)
    u_why = np.where((u_why == 0) & (symbols > MAX_SYMBOLS * b_n), _CODE["symbols"], u_why)
    u_why = np.where((why[first] == 0) & (damage > MAX_DAMAGE * b_n), _CODE["encoding"], u_why)
    word_of, words = _words(np.arange(len(first)), bare, r"[^\pL\pN]+")
    article = _np(pc.is_in(words, pa.array(ARTICLES, words.type)))
    ordinary = _np(pc.is_in(words, common)) & ~_np(pc.is_in(words, pa.array(AFTER_ARTICLE, words.type)))
    followed = article[:-1] & (word_of[1:] == word_of[:-1])
    total = np.bincount(word_of[:-1][followed], minlength=len(first))
    wrong = np.bincount(word_of[:-1][followed & ordinary[1:]], minlength=len(first))
    u_why = np.where((u_why == 0) & (total >= SALAD_ARTICLES) & (wrong > MAX_SALAD * total), _CODE["salad"], u_why)

    # sentences of the rest
    sound = u_why == 0
    cut = pc.replace_substring_regex(_pick(units, sound), r"([.!?][\"'”’»)\]]*)\s+", "\\1\n")
    owner, sentences = _split(np.flatnonzero(sound), cut, "\n")
    t = pc.replace_substring_regex(sentences, _BULLET, "")
    t_n = _np(pc.utf8_length(t)).astype(np.int64)
    some = t_n > 0
    owner, sentences, t, t_n = owner[some], _pick(sentences, some), _pick(t, some), t_n[some]
    letters, commas = _count(t, (1, 8))
    at, words = _words(np.arange(len(owner)), t, r"[^\pL]+")
    n_words = np.bincount(at, minlength=len(owner))
    n_common = np.bincount(at[_np(pc.is_in(words, common)).astype(bool)], minlength=len(owner))
    whole = ~sound
    zeros = np.zeros(whole.sum(), np.int64)
    return {
        "doc": np.concatenate([u_doc[whole], u_doc[owner]]),
        "n": np.concatenate([u_n[whole], _np(pc.utf8_length(sentences)).astype(np.int64)]),
        "why": np.concatenate([u_why[whole], np.zeros(len(owner), u_why.dtype)]),
        "menu": np.concatenate([np.zeros(len(zeros), bool), menu[owner]]),
        "length": np.concatenate([zeros, t_n]),
        "letters": np.concatenate([zeros, letters]),
        "words": np.concatenate([zeros, n_words]),
        "common": np.concatenate([zeros, n_common]),
        "commas": np.concatenate([zeros, commas]),
        "ended": np.concatenate([zeros > 0, _hits(t, _END)]),
        "bullet": np.concatenate([zeros > 0, _hits(sentences, _BULLET)]),
        "text": pa.concat_arrays([_pick(units, whole), sentences]),
    }


def _words(owner: np.ndarray, strings: pa.Array, other: str) -> tuple[np.ndarray, pa.Array]:
    """The lower-cased words of the strings, each with the string's owner."""
    spaced = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(strings), other, " "), " ")
    owner, words = _split(owner, spaced, " ")
    some = _np(pc.binary_length(words)) > 0
    return owner[some], _pick(words, some)


def part_failures(p: dict[str, np.ndarray]) -> np.ndarray:
    """The reason (number in ``REASONS``) by which each part fails, 0 if it is a running sentence."""
    per = np.maximum(1, p["words"])
    few = p["letters"] < np.where(p["ended"] & (p["words"] >= MIN_WORDS_CLOSED), MIN_LETTERS_CLOSED, MIN_LETTERS_OPEN) * p["length"]
    reads_on = (p["words"] >= MIN_WORDS_OPEN) & (p["common"] >= MIN_COMMON_OPEN * per) & (p["commas"] < MAX_COMMAS_OPEN * per)
    good = np.where(p["ended"], p["words"] >= MIN_WORDS_CLOSED, reads_on)
    other = np.where(p["bullet"] & ~p["ended"], _CODE["bullets"], _CODE["fragment"])
    why = np.where(p["why"] > 0, p["why"], np.where(few, _CODE["digits"], np.where(good, 0, other)))
    why = np.where((why == 0) & p["menu"], _CODE["menu"], why)
    again = _held(p["doc"], p["text"], (why == 0).astype(float)) >= REPEATS
    return np.where((why == 0) & again, _CODE["repeated"], why)


def verdicts(texts: list[str], common: pa.Array) -> tuple[np.ndarray, list[str | None]]:
    """Per text, the share of its characters in running sentences, and the reason that takes most of the rest."""
    p = part_statistics(texts, common)
    why = part_failures(p)
    cells = np.bincount(p["doc"] * len(REASONS) + why, weights=p["n"], minlength=len(texts) * len(REASONS)).reshape(len(texts), len(REASONS))
    total = cells.sum(axis=1)
    share = np.divide(cells[:, 0], total, out=np.zeros(len(texts)), where=total > 0)
    lost = cells[:, 1:]
    return share, [REASONS[1 + k] if m > 0 else None for k, m in zip(lost.argmax(axis=1), lost.max(axis=1))]


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for k, t in enumerate(texts):
        if k > lo and size + len(t) > CHUNK_BYTES:
            yield lo, k
            lo, size = k, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _share(words: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = pa.array(words, pa.large_string())
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in _chunks(texts):
                share, reason = verdicts(texts[lo:hi], common)
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[lo:hi], pa.array(share, pa.float64()), pa.array(reason, pa.string())], ["doc_id", "prose_share", "reason"])

    return run


def _common(words: DataFrame) -> list[str]:
    """The table of common words, a stated word list: the one thing every task needs whole."""
    return sorted(r[0] for r in words.where("word is not null").select(F.lower("word")).distinct().collect())


def prose_share(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, prose_share, reason) of each document with a text that isn't blank:
    the share of its characters in running sentences, and the commonest reason
    against the rest."""
    slim = docs.select("doc_id", "text").where("text is not null and text rlike '\\\\S'")
    return slim.mapInArrow(_share(_common(words)), "doc_id bigint, prose_share double, reason string")


def statistics(docs: DataFrame, words: DataFrame) -> DataFrame:
    """Whole-document statistics, one row per document."""
    common = _common(words)
    t = F.col("text")
    d = docs.select("doc_id", "text").withColumn("words", F.filter(F.split(t, r"\s+"), lambda w: w != "")).withColumn("lines", F.filter(F.split(t, r"\n"), lambda x: x.rlike(r"\S")))
    n, m = F.size("words"), F.size("lines")
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    letters = F.length(F.regexp_replace(F.lower(t), r"[^\p{L}]+", ""))
    runs = F.regexp_extract_all(F.lower(t), F.lit(r"\p{L}+"), F.lit(0))
    lower = F.transform("lines", lambda x: F.trim(F.lower(x)))
    distinct = F.aggregate(F.array_distinct(lower), F.lit(0), lambda a, x: a + F.length(x))
    every = F.aggregate(lower, F.lit(0), lambda a, x: a + F.length(x))
    given = F.array(*(F.lit(w) for w in common)) if common else F.array().cast("array<string>")
    hits = F.size(F.filter(runs, lambda w: F.array_contains(given, w)))
    stats = d.select(
        "doc_id",
        n.alias("n_words"),
        m.alias("n_lines"),
        F.length(t).alias("n_chars"),
        ratio(F.aggregate("words", F.lit(0), lambda a, x: a + F.length(x)), n).alias("mean_word_length"),
        ratio(F.size(F.regexp_extract_all(t, F.lit(r"#|…|\.\.\."), F.lit(0))), n).alias("symbol_ratio"),
        ratio(F.size(F.filter("lines", lambda x: x.rlike(r"^\s*[-*•–]\s"))), m).alias("bullet_lines"),
        ratio(F.size(F.filter("lines", lambda x: x.rlike(r"(…|\.\.\.)\s*$"))), m).alias("ellipsis_lines"),
        ratio(F.size(F.filter("lines", lambda x: x.rlike("[.!?][\"')]?\\s*$"))), m).alias("punctuated_lines"),
        ratio(F.size(F.filter("words", lambda x: x.rlike(r"\p{L}"))), n).alias("alpha_words"),
        ratio(letters, F.length(t)).alias("letter_share"),
        ratio(hits, F.size(runs)).alias("common_words"),
        hits.alias("n_common"),
        ratio(every - distinct, every).alias("repeated_lines"),
    )
    return stats


def failures(stats: DataFrame) -> DataFrame:
    """The statistics with ``failed``: the names of the rules a document fails, in order."""
    rules = [
        ("word_count", (F.col("n_words") < MIN_WORDS) | (F.col("n_words") > MAX_WORDS)),
        ("mean_word_length", (F.col("mean_word_length") < MIN_MEAN_LENGTH) | (F.col("mean_word_length") > MAX_MEAN_LENGTH)),
        ("symbol_ratio", F.col("symbol_ratio") > MAX_SYMBOL_RATIO),
        ("bullet_lines", F.col("bullet_lines") > MAX_BULLET_LINES),
        ("ellipsis_lines", F.col("ellipsis_lines") > MAX_ELLIPSIS_LINES),
        ("alpha_words", F.col("alpha_words") < MIN_ALPHA_WORDS),
        ("common_words", F.col("n_common") < MIN_COMMON_WORDS),
        ("repeated_lines", F.col("repeated_lines") > MAX_REPEATED_LINES),
    ]
    return stats.withColumn("failed", F.concat_ws(",", *(F.when(c, F.lit(n)) for n, c in rules)))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which more than half isn't running sentences."""
    return prose_share(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words")).where("prose_share < 0.5").select("doc_id")


def p10_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's share of prose and the commonest reason against the rest."""
    return prose_share(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-document statistics and the published rules failed."""
    s = failures(statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words")))
    return s.where("n_chars is not null")


def queries():
    return {"p10_found": p10_found, "p10_reasons": p10_reasons, "p10_statistics": p10_statistics}


def oracle_sql():
    return {"p10_statistics": _SQL}


_SQL = r"""WITH c AS (SELECT DISTINCT lower(word) AS w FROM common_words WHERE word IS NOT NULL),
d AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')) AS lines,
  regexp_extract_all(lower(text), '\p{L}+') AS runs FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(runs) AS w FROM d),
h AS (SELECT doc_id, count(*) AS hits FROM u JOIN c USING (w) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(lines) AS x FROM d),
lx AS (SELECT doc_id, trim(lower(x)) AS x, count(*) AS k FROM l GROUP BY ALL),
r AS (SELECT doc_id, sum(k * length(x)) AS every, sum(length(x)) AS distinct_len FROM lx GROUP BY doc_id),
s AS (SELECT d.doc_id, len(words)::INT AS n_words, len(lines)::INT AS n_lines, length(text)::INT AS n_chars,
  round(coalesce(list_sum(list_transform(words, lambda x: length(x)))::DOUBLE / nullif(len(words), 0), 0), 6) AS mean_word_length,
  round(coalesce(len(regexp_extract_all(text, '#|…|\.\.\.'))::DOUBLE / nullif(len(words), 0), 0), 6) AS symbol_ratio,
  round(coalesce(len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[-*•–]\s')))::DOUBLE / nullif(len(lines), 0), 0), 6) AS bullet_lines,
  round(coalesce(len(list_filter(lines, lambda x: regexp_matches(x, '(…|\.\.\.)\s*$')))::DOUBLE / nullif(len(lines), 0), 0), 6) AS ellipsis_lines,
  round(coalesce(len(list_filter(lines, lambda x: regexp_matches(x, '[.!?]["'')]?\s*$')))::DOUBLE / nullif(len(lines), 0), 0), 6) AS punctuated_lines,
  round(coalesce(len(list_filter(words, lambda x: regexp_matches(x, '\p{L}')))::DOUBLE / nullif(len(words), 0), 0), 6) AS alpha_words,
  round(coalesce(length(regexp_replace(lower(text), '[^\p{L}]+', '', 'g'))::DOUBLE / nullif(length(text), 0), 0), 6) AS letter_share,
  round(coalesce(coalesce(hits, 0)::DOUBLE / nullif(len(runs), 0), 0), 6) AS common_words, coalesce(hits, 0)::INT AS n_common,
  round(coalesce((every - distinct_len)::DOUBLE / nullif(every, 0)::DOUBLE, 0), 6) AS repeated_lines
  FROM d LEFT JOIN h USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT *, concat_ws(',', CASE WHEN n_words < 50 OR n_words > 100000 THEN 'word_count' END,
  CASE WHEN mean_word_length < 3 OR mean_word_length > 10 THEN 'mean_word_length' END, CASE WHEN symbol_ratio > 0.1 THEN 'symbol_ratio' END,
  CASE WHEN bullet_lines > 0.9 THEN 'bullet_lines' END, CASE WHEN ellipsis_lines > 0.3 THEN 'ellipsis_lines' END,
  CASE WHEN alpha_words < 0.8 THEN 'alpha_words' END, CASE WHEN n_common < 2 THEN 'common_words' END, CASE WHEN repeated_lines > 0.3 THEN 'repeated_lines' END) AS failed FROM s"""
