"""Variant spellings of the names of persons and organisations.

1. Names are folded (case, accents, punctuation) into tokens; titles, particles
   and the little words of organisations are set aside.
2. A symmetric-delete index on the distinct tokens (every token with each one
   character left out) finds all pairs of tokens within one edit or swap. Each
   token follows its most frequent neighbour, twice at most, to a root.
3. Two names can agree only by a long word and a further word, acronym or
   initial; names that share such two stand in a block, whatever the words'
   frequency. Since no two names may both have whole words left over, one of a
   pair holds all its words in the other: so one of the two words is that name's
   rarest (the other name gives all its words), or, by initials alone, each
   name's whole words are initials of the other. Misspelt words, short forms,
   abbreviations and acronyms are looked up between the distinct words first; a
   block compares short with full forms only.
4. In a block, each name follows the best of the fuller ones, by optimal
   assignment of tokens, permitting equal
   roots, one edit, known, learned and regular short forms, abbreviations, initials
   and acronyms. It follows one alone: a bare initial that goes with two authors
   mustn't make them one. Blocks of more than ``SALT_ROWS`` names are cut into
   salts, every two salts of which are one task, so none holds a block.
5. Connected components of the links are the authors.

Defined cases: null or blank names are left out; names are compared as trimmed
strings, so spellings that differ in case or dots are different strings; a
name without a token of four letters links only to equal letters, as the words
an acronym stands for don't make it a long one; a lone
surname links to nobody; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import discard, materialize
from ..sources.tables import table
from .components import components

#: Anchors, words that tell names apart: a name's longest root, and those within this factor of its rarest.
ANCHOR_SPREAD = 4.0
SALT_ROWS = 1000
BLOCK = 256
#: What a name is to a block: the block is by its rarest word or by initials; a full form; a short form; the long word is its anchor.
OWN, FULL, SHORT, ANCHOR = 1, 2, 4, 8
EVERY = OWN | FULL | SHORT | ANCHOR
#: Tokens that don't tell names apart (fixed values).
TITLES = frozenset(("dr", "prof", "professor", "mr", "mrs", "ms", "sir", "phd", "md", "jr", "sr"))
ASIDE = TITLES | frozenset(("de", "del", "della", "der", "den", "di", "du", "da", "el", "la", "le", "van", "von", "zu", "of", "the", "for", "on", "and", "in", "at", "und", "fur", "et", "des", "y"))
#: Share of a short form's surnames that must also go with the full form.
LEARN_SHARE = 0.75


def fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower().replace("ß", "ss")) if not unicodedata.combining(c))


def parse(name: str) -> tuple[list[str], str]:
    """Tokens in order, and the letters of the whole name without anything between.
    Short runs of capitals in a name of mixed case are marked with ``*``: they may be
    initials written together or an acronym. Later parts of hyphenated names are
    marked with ``-``: they may be missing elsewhere."""
    words = re.findall(r"-?[^\W_]+\.?", name)
    mixed = any(c.islower() for c in name) and not any(w.strip("-.").isupper() and len(w) > 4 for w in words)
    tokens = []
    for w in words:
        t = w.strip("-.")
        f, caps = fold(t), mixed and 2 <= len(t) <= 4 and t.isupper() and t.isalpha()
        if f in ASIDE and not (caps and len(t) <= 3) and not (w[-1] == "." and f not in TITLES):
            continue
        tokens.append(f + "*" if caps else "-" + f if w[0] == "-" and len(f) > 3 and tokens else f)
    return tokens, "".join(re.findall(r"[^\W_]+", fold(name)))


def near(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if abs(la - lb) > 1:
        return False
    i = 0
    while i < min(la, lb) and a[i] == b[i]:
        i += 1
    if la == lb:
        return a[i + 1 :] == b[i + 1 :] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1])
    return a[i + 1 :] == b[i:] if la > lb else a[i:] == b[i + 1 :]


def token_score(a: str, b: str, roots: dict, alts: dict) -> float:
    """How well two tokens agree: 1 the same word, down to 0.5 for an initial, 0 not at all."""
    if a == b:
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 1:
        return 0.5 if b[0] == a else 0.0
    if roots.get(a, a) == roots.get(b, b) and len(a) > 3:
        return 1.0
    if len(a) > 3 and near(a, b):
        return 0.95
    if len(a) == 3 and len(b) >= 3 and near(a, b) and a[0] == b[0]:
        return 0.7
    if b in alts.get(a, ()) or a in alts.get(b, ()):
        return 0.9
    if b.startswith(a):
        return 0.8
    stem = a[:-1]
    if len(stem) >= 2 and a[-1] in "iyoe" and b.startswith(stem):  # regular short forms
        return 0.75
    if len(a) > 2 and a[0] == b[0] and not set(a[1:]) & set("aeiou"):  # a word without its vowels
        rest = iter(b)
        if all(c in rest for c in a):
            return 0.75
    return 0.0


def assign(x: list[str], y: list[str], roots: dict, alts: dict) -> list[tuple[int, int, float]]:
    """Optimal one-to-one assignment of tokens by total score, of equal ones that nearest in place:
    tokens are added one by one along the cheapest augmenting path (Hungarian method)."""
    flip = len(x) > len(y)
    if flip:
        x, y = y, x
    s = [[token_score(a, b, roots, alts) for b in y] for a in x]
    n, m = len(x), len(y)
    cost = [[0.001 * abs(i - j) - v if v > 0 else 0.0 for j, v in enumerate(row)] for i, row in enumerate(s)]
    u, v, owner = [0.0] * (n + 1), [0.0] * (m + 1), [-1] * (m + 1)  # column m is where a path begins
    for i in range(n):
        owner[m], j = i, m
        slack, way, done = [float("inf")] * (m + 1), [m] * (m + 1), [False] * (m + 1)
        while owner[j] != -1:
            done[j] = True
            r, least, to = owner[j], float("inf"), m
            for k in range(m):
                if not done[k]:
                    c = cost[r][k] - u[r] - v[k]
                    if c < slack[k]:
                        slack[k], way[k] = c, j
                    if slack[k] < least:
                        least, to = slack[k], k
            for k in range(m + 1):
                if done[k]:
                    u[owner[k]] += least
                    v[k] -= least
                else:
                    slack[k] -= least
            j = to
        while j != m:
            owner[j], j = owner[way[j]], way[j]
    out = sorted((owner[j], j, s[owner[j]][j]) for j in range(m) if owner[j] != -1 and s[owner[j]][j] > 0)
    return [(j, i, w) for i, j, w in out] if flip else out


def _spread(tokens: list[str], other: list[str]) -> list[str]:
    """Written-together capitals: an acronym of the other name becomes the words it
    stands for, else single initials."""
    out = []
    for t in tokens:
        if not t.endswith("*"):
            out.append(t)
            continue
        t = t[:-1]
        plain = [o.rstrip("*") for o in other]
        if t in plain:
            out.append(t)
            continue
        heads = [o[0] for o in plain]
        at = next((k for k in range(len(heads)) if heads[k : k + len(t)] == list(t)), None)
        if at is not None and all(len(o) > 2 for o in plain[at : at + len(t)]):
            out.extend(plain[at : at + len(t)])
        else:
            out.extend(t)
    return out


def _initials(tokens: list[str]) -> list[str]:
    return sorted(c for t in tokens if len(t) == 1 or t.endswith("*") for c in t.rstrip("*"))


def agreement(a: list[str], b: list[str], sa: str, sb: str, roots: dict, alts: dict, firm: tuple[dict, dict] | None = None) -> float:
    """0: different or undecided names; else the total score of the alignment.

    One long word must agree, and one further token. What is left over on both
    sides contradicts, unless it is a mere initial on one of them. If the further
    tokens agree by initials alone, no whole word may be left over either, so the
    middle initial of one name doesn't stand for the given name of another; only
    the later part of a hyphenated name may be missing. ``firm``: each name's anchors, with 2
    for the rarest and 1 for the longest. With these, a long word that both names write out
    must agree; it must be among the rarest of either or an anchor of both, since a word that is
    frequent beside others, as a given name, and initials that go with the rest, name nobody; and the one letter in which names differ mustn't be an initial."""
    alike = len(sa) > 7 and near(sa, sb)
    if sa == sb or (alike and not firm):
        return 9.0
    loose = {t[1:] for t in (*a, *b) if t[0] == "-"}
    x, y = _spread([t.lstrip("-") for t in a], [t.lstrip("-") for t in b]), _spread([t.lstrip("-") for t in b], [t.lstrip("-") for t in a])
    m = assign(x, y, roots, alts)
    if firm:
        held, kept = {t.strip("-") for t in a}, {t.strip("-") for t in b}
        long = [(i, j) for i, j, v in m if v >= 0.9 and min(len(x[i]), len(y[j])) > 3 and x[i] in held and y[j] in kept]
        if not any(firm[0].get(x[i], 0) + firm[1].get(y[j], 0) > 1 for i, j in long):
            return 0.0
        if alike and _initials(a) == _initials(b) and (len(m) > 1 or any({t[0] for k, t in enumerate(x) if k != i} & {t[0] for k, t in enumerate(y) if k != j} for i, j in long)):
            return 9.0
    if len(m) < 2 or not any(v >= 0.9 and min(len(x[i]), len(y[j])) > 3 for i, j, v in m):
        return 0.0
    ix, jy = {i for i, _, _ in m}, {j for _, j, _ in m}
    ux, uy = [t for i, t in enumerate(x) if i not in ix], [t for j, t in enumerate(y) if j not in jy]
    full_x, full_y = [t for t in ux if len(t) > 1], [t for t in uy if len(t) > 1]
    if ux and uy and bool(full_x) == bool(full_y):
        return 0.0
    strong = sorted((v for i, j, v in m if min(len(x[i]), len(y[j])) > 1), reverse=True)
    if len(strong) < 2 and any(t not in loose for t in full_x + full_y):
        return 0.0
    if len(strong) < 2:  # by initials alone: the first one must be among them
        i, j, _ = max(m, key=lambda c: min(len(x[c[0]]), len(y[c[1]])))
        if next(k for k in range(len(x)) if k != i) not in ix or next(k for k in range(len(y)) if k != j) not in jy:
            return 0.0
    return sum(v for _, _, v in m)


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        got = [parse(n) for n in p["name"]]
        yield pd.DataFrame({"name": p["name"], "n": p["n"], "tokens": [g[0] for g in got], "letters": [g[1] for g in got]})


def distinct_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, n): trimmed author strings of both sources, over all rows."""
    c = table(spark, sf_dir, "parsed_citations").select("authors", "raw_text")
    head = F.regexp_extract("raw_text", r"(?s)^(.*?): ", 1)
    block = F.when(F.col("raw_text").startswith('"'), F.lit("")).otherwise(F.regexp_replace(head, r"(?i)\s*\bet al\.?\s*$", ""))
    both = c.select(F.explode("authors").alias("name")).unionByName(c.select(F.explode(F.split(block, "; ")).alias("name")))
    return both.select(F.trim("name").alias("name")).where("name is not null and name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def near_tokens(tokens: DataFrame) -> DataFrame:
    """(token, other, df, odf): all two tokens of three letters and more within one edit or swap, the commoner one
    as ``other``. ``tokens``: (name_id, token)."""
    df = materialize(tokens.where("length(token) > 2").groupBy("token").agg(F.countDistinct("name_id").alias("df")), "token-df")
    keys = df.select("token", "df", F.explode(F.array_distinct(F.concat(F.array("token"), _cuts("token")))).alias("key"))
    pairs = keys.join(keys.select(F.col("token").alias("other"), F.col("df").alias("odf"), "key"), "key").where("other <> token and (odf > df or (odf = df and other > token))").select("token", "other", "odf").distinct()
    return materialize(pairs.where(_near_udf()("token", "other")), "token-near")


def _cuts(c: str):
    """The text with each one letter left out."""
    return F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.col(c).substr(i + 1, F.length(c))))


def token_roots(close: DataFrame) -> DataFrame:
    """(token, root) for tokens of six letters and more that differ from their root, of :func:`near_tokens`."""
    close = close.where("length(token) > 5 and length(other) > 5")
    up = materialize(close.groupBy("token").agg(F.max(F.struct("odf", "other")).alias("m")).select("token", F.col("m.other").alias("root")), "token-up")
    again = up.select(F.col("token").alias("root"), F.col("root").alias("second"))
    return up.join(again, "root", "left").select("token", F.coalesce("second", "root").alias("root"))


def _vowelless_udf():
    @F.pandas_udf("boolean")
    def within(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([(rest := iter(y)) is not None and all(c in rest for c in x) for x, y in zip(a, b)], dtype=bool)

    return within


def token_marks(words: DataFrame, close: DataFrame, roots: DataFrame, alts: DataFrame) -> DataFrame:
    """(token, marks): marks (mark, side, strong) that a token shares with those it agrees with by :func:`token_score`,
    besides its root. ``words``: (token), distinct, none of them an acronym."""
    size = F.length
    root = lambda c: roots.select(F.col("token").alias(c), F.col("root").alias(f"{c}_root"))
    far = close.join(root("token"), "token", "left").join(root("other"), "other", "left").where("coalesce(token_root, token) <> coalesce(other_root, other)")
    far = far.where("(length(token) > 3 and length(other) > 3) or left(token, 1) = left(other, 1)").select("token", "other", F.concat(F.lit("~"), "token", F.lit("~"), "other").alias("mark"), (F.least(size("token"), size("other")) > 3).alias("strong"))
    near_ = far.select("token", "mark", F.lit(FULL | SHORT).alias("side"), "strong").unionByName(far.select(F.col("other").alias("token"), "mark", F.lit(FULL | SHORT).alias("side"), "strong"))
    held = alts.select("token", "given").join(words, "token", "left_semi").join(words.select(F.col("token").alias("given")), "given", "left_semi").select("token", "given", F.concat(F.lit(">"), "token", F.lit(">"), "given").alias("mark"), (F.least(size("token"), size("given")) > 3).alias("strong"))
    short = held.select("token", "mark", F.lit(SHORT).alias("side"), "strong").unionByName(held.select(F.col("given").alias("token"), "mark", F.lit(FULL).alias("side"), "strong"))
    # a word is short for those that begin like it, or like it without a closing vowel
    begins = words.where(size("token") > 1).select("token", F.explode(F.transform(F.sequence(F.lit(2), size("token")), lambda n: F.left("token", n))).alias("head"))
    heads = words.where(size("token") > 1).select(F.col("token").alias("form"), F.col("token").alias("head")).unionByName(words.where("length(token) > 2 and right(token, 1) in ('i', 'y', 'o', 'e')").select(F.col("token").alias("form"), F.expr("left(token, length(token) - 1)").alias("head")))
    met = heads.join(begins, "head").where("form <> token and length(form) <= length(token)").select("form", "token", F.concat(F.lit("^"), "head").alias("mark"))
    bare = words.where(r"length(token) > 2 and not substring(token, 2) rlike '[aeiou]'").select(F.col("token").alias("form"), F.left("token", F.lit(1)).alias("head"))
    thin = bare.join(words.select("token", F.left("token", F.lit(1)).alias("head")), "head").where("form <> token and length(form) <= length(token)").where(_vowelless_udf()("form", "token")).select("form", "token", F.concat(F.lit("*"), "form").alias("mark"))
    met = met.unionByName(thin)
    regular = met.select(F.col("form").alias("token"), "mark", F.lit(SHORT).alias("side")).unionByName(met.select("token", "mark", F.lit(FULL).alias("side"))).distinct().withColumn("strong", F.lit(False))
    every = near_.unionByName(short).unionByName(regular)
    return every.groupBy("token").agg(F.collect_list(F.struct("mark", "side", "strong")).alias("marks"))


def _name_keys(tokens: list[str], letters: str, told: dict) -> dict[str, int]:
    """Blocks of a name, with what it is to them: every two names that agree share one in which they are compared.
    ``told``: token to (root, df, whether an anchor, marks)."""
    keys: dict[str, int] = defaultdict(int)
    keys["=" + letters] = EVERY
    caps, loose, words = [t.endswith("*") for t in tokens], [t[0] == "-" for t in tokens], [t.strip("-*") for t in tokens]
    long = [i for i, t in enumerate(words) if len(t) > 3 and not caps[i]]
    if not long:
        return keys
    rare = min(long, key=lambda i: (told[words[i]][1], words[i]))
    marks, strong = [], []
    for t in words:
        root, _, _, edges = told[t]
        marks.append([("=" + root, FULL | SHORT, len(t) > 3), *edges] if len(t) > 1 else [])
        strong.append([m for m, _, s in marks[-1] if s])
    initials = {c for t, c_ in zip(words, caps) if c_ or len(t) == 1 for c in t}
    n_words = sum(c or len(t) > 1 for t, c in zip(words, caps))
    runs = [(range(i, i + n), "&" + "".join(t[0] for t in words[i : i + n])) for n in (2, 3, 4) for i in range(len(words) - n + 1) if all(len(t) > 2 for t in words[i : i + n])]
    for i in long:
        rest = [j for j in range(len(words)) if j != i]
        whole = min((words[j][0] for j in rest if not caps[j] and len(words[j]) > 1 and not loose[j]), default="")
        for s in strong[i]:
            firm = ANCHOR if told[words[i]][2] else 0
            own = firm | (OWN if i == rare else 0)
            for j in rest:
                for m, side, also in marks[j]:
                    keys["|".join(sorted((s, m)) if also else (s, m))] |= side | own | (OWN if j == rare else 0)
                if caps[j]:
                    keys[f"{s}|&{words[j]}"] |= SHORT | own
            for at, heads in runs:
                keys[f"{s}|{heads}"] |= FULL | own | (OWN if rare in at else 0)
            # two further words agree, and of the rarest its initial
            if n_words > 2 and i != rare:
                keys[f"{s}|.{words[rare][0]}"] |= FULL | OWN | firm
            if n_words > 1:
                for c in initials:
                    keys[f"{s}|.{c}"] |= SHORT | firm
            # by initials alone: one whole word of each name, if it has any, is an initial of the other
            for c in initials | {""} if whole else initials:
                x, y = sorted((whole, c))
                keys[f"{s}|!{x},{y}"] |= OWN | firm | (FULL | SHORT if x == y else FULL if whole == x else SHORT)
            if not whole:
                for c in initials | {words[j][0] for j in rest if loose[j]}:
                    keys[f"{s}|!!{c}"] |= OWN | FULL | SHORT | firm
    return keys


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        ids, keys, flags = [], [], []
        for uid, tokens, letters, told in zip(p["name_id"], p["tokens"], p["letters"], p["told"]):
            got = _name_keys(list(tokens), letters, {} if told is None else {e["token"]: (e["root"], e["df"] or 0, e["anchor"], [] if e["marks"] is None else [(m["mark"], m["side"], m["strong"]) for m in e["marks"]]) for e in told})
            ids += [uid] * len(got)
            keys += got.keys()
            flags += got.values()
        yield pd.DataFrame({"name_id": ids, "key": keys, "flags": flags})


def _near_udf():
    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([near(x, y) for x, y in zip(a, b)], dtype=bool)

    return close


def _met(f: int, g: int) -> bool:
    """Whether a block compares two of its names."""
    return bool((f | g) & OWN and (f | g) & ANCHOR and (f & FULL and g & SHORT or f & SHORT and g & FULL))


def _read(tokens, roots, letters, alts, anchors) -> tuple:
    toks = list(tokens)
    own = {t: r for t, r in zip((t.lstrip("-") for t in toks), roots) if t != r}
    return toks, own, letters, {e["token"]: set(e["given"]) for e in alts} if alts is not None else {}, {e["token"]: e["anchor"] for e in anchors} if anchors is not None else {}


def _agree(x: tuple, y: tuple) -> float:
    return agreement(x[0], y[0], x[2], y[2], {**y[1], **x[1]}, {**y[3], **x[3]}, (x[4], y[4]))


def _followers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reads blocks sorted by fullness; yields (best fuller one, name) links."""
    key, block = None, []
    for p in batches:
        out_a, out_b = [], []
        for k, uid, flags, *rest in zip(p["key"], p["name_id"], p["flags"], p["tokens"], p["roots"], p["letters"], p["alts"], p["anchors"]):
            if k != key:
                key, block = k, []
            me = _read(*rest)
            best, to = 0.0, None
            for l_uid, l_flags, other in block:
                if _met(flags, l_flags):
                    v = _agree(me, other)
                    if v > best:
                        best, to = v, l_uid
            block.append((uid, flags, me))
            if to is not None:
                out_a.append(to), out_b.append(uid)
        yield pd.DataFrame({"a": out_a, "b": out_b}, dtype="int64")


def _best_fuller(p: pd.DataFrame) -> pd.DataFrame:
    """Of one tile pair, each name's best among the fuller ones of the other side (of its own, if the sides are one)."""
    rows = [(f, u, g, side, _read(*rest)) for f, u, g, side, *rest in zip(p["fullness"], p["name_id"], p["flags"], p["side"], p["tokens"], p["roots"], p["letters"], p["alts"], p["anchors"])]
    rows.sort(key=lambda r: (-r[0], r[1]))
    one = len({r[3] for r in rows}) == 1
    out = []
    for k, (_, uid, flags, side, me) in enumerate(rows):
        best, to, full = 0.0, None, 0
        for fullness, l_uid, l_flags, l_side, other in rows[:k]:
            if (one or l_side != side) and _met(flags, l_flags):
                v = _agree(me, other)
                if v > best:
                    best, to, full = v, l_uid, fullness
        if to is not None:
            out.append((p["key"].iloc[0], to, uid, best, full))
    return pd.DataFrame(out, columns=["key", "a", "b", "v", "full"]).astype({"a": "int64", "b": "int64", "v": float, "full": "int64"})


def _tiled(large: DataFrame, info: DataFrame) -> DataFrame:
    """(a, b): each name of a block linked to its best fuller one, salts taken two by two. Rows: (key, name_id, flags, size)."""
    n = F.ceil(F.col("size") / SALT_ROWS).cast("int")
    s = F.pmod(F.xxhash64("name_id"), n).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda o: F.struct(F.least(s, o).alias("i"), F.greatest(s, o).alias("j")))
    dealt = large.select("key", "name_id", "flags", s.alias("side"), F.explode(pairs).alias("t")).select("key", "name_id", "flags", "side", "t.i", "t.j").join(info, "name_id")
    best = dealt.groupBy("key", "i", "j").applyInPandas(_best_fuller, "key string, a bigint, b bigint, v double, full bigint")
    return best.groupBy("key", "b").agg(F.max(F.struct("v", "full", (-F.col("a")).alias("o"))).alias("m")).select((-F.col("m.o")).alias("a"), "b")


def learned_short_forms(rooted: DataFrame, anchors: DataFrame) -> DataFrame:
    """(token, given): short forms that the table of short names lacks.

    A token is a short form of another word if, of the anchors (surnames) it goes
    with, at least three and at least ``LEARN_SHARE`` also go with that word, the
    two share three letters in a row and never stand in one name."""
    words = rooted.where("length(token) > 2 and not caps")
    by = anchors.join(words.select("name_id", "root"), "name_id").where("root <> anchor").select("anchor", "root").distinct()
    total = by.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    rare = by.join(total.where("n > 2"), "root")
    pairs = rare.select("anchor", F.col("root").alias("token"), "n").join(rare.select("anchor", F.col("root").alias("given"), F.col("n").alias("gn")), "anchor")
    pairs = pairs.where("token <> given and n < gn and length(token) < length(given)").groupBy("token", "given", "n").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= F.greatest(F.lit(3), F.col("n") * LEARN_SHARE))
    grams = F.transform(F.sequence(F.lit(1), F.length("token") - 2), lambda i: F.col("token").substr(i, F.lit(3)))
    pairs = pairs.where(F.exists(grams, lambda g: F.contains("given", g)))
    x, y = words.select("name_id", F.col("root").alias("token")), words.select("name_id", F.col("root").alias("given"))
    together = pairs.join(x, "token").join(y, ["name_id", "given"]).select("token", "given").distinct()
    return pairs.select("token", "given").join(together, ["token", "given"], "left_anti")


def _one_letter_off(parsed: DataFrame) -> DataFrame:
    """(name_id, key, flags): a block for every two strings of letters, of more than seven, within one edit or swap."""
    letters = parsed.where("length(letters) > 6").select("letters").distinct()
    cut = letters.select("letters", F.explode(F.array_distinct(F.concat(F.array("letters"), _cuts("letters")))).alias("cut")).select("letters", F.xxhash64("cut").alias("cut"))
    met = cut.join(cut.select(F.col("letters").alias("other"), "cut"), "cut").where("letters < other and (length(letters) > 7 or length(other) > 7)").select("letters", "other").distinct()
    met = met.where(_near_udf()("letters", "other")).withColumn("key", F.concat(F.lit("~"), "letters", F.lit("~"), "other"))
    both = met.select("letters", "key").unionByName(met.select(F.col("other").alias("letters"), "key"))
    return parsed.select("name_id", "letters").join(both, "letters").select("name_id", "key", F.lit(EVERY).alias("flags"))


def authors(names: DataFrame, short_names: DataFrame | None = None, tag: str = "names") -> DataFrame:
    """(name, n, name_id, author): the author of every distinct name; ``author`` is the least name_id of the group.

    ``short_names``: (given_name, short_name), known short forms, joined like any table."""
    parsed = names.mapInPandas(_parsed, "name string, n bigint, tokens array<string>, letters string")
    parsed = materialize(parsed.withColumn("name_id", F.monotonically_increasing_id()), f"{tag}-parsed")
    raw = parsed.select("name_id", F.explode("tokens").alias("t"))
    tokens = raw.select("name_id", F.regexp_replace("t", "[*-]", "").alias("token"), F.col("t").endswith("*").alias("caps")).distinct()
    close = near_tokens(tokens.where("not caps").select("name_id", "token"))
    roots = materialize(token_roots(close), f"{tag}-roots")
    rooted = tokens.join(roots, "token", "left").select("name_id", "token", "caps", F.coalesce("root", "token").alias("root"))
    long = (F.length("token") > 3) & ~F.col("caps")
    df = rooted.where(long).groupBy("root").agg(F.countDistinct("name_id").alias("df"))
    rooted = materialize(rooted.join(df, "root", "left"), f"{tag}-rooted")
    least = rooted.where(long).groupBy("name_id").agg(F.min("df").alias("least"), F.max(F.struct(F.length("token").alias("len"), "root")).alias("longest"))
    anchors = rooted.where(long).join(least, "name_id").where((F.col("df") <= F.col("least") * ANCHOR_SPREAD) | (F.col("root") == F.col("longest.root"))).groupBy("name_id", F.col("root").alias("anchor")).agg(F.max(F.when(F.col("df") <= F.col("least") * ANCHOR_SPREAD, 2).otherwise(1)).alias("firm"))
    anchors = materialize(anchors, f"{tag}-anchors")
    known = learned_short_forms(rooted, anchors)
    if short_names is not None:
        fold_udf = F.pandas_udf(lambda s: s.map(lambda x: fold(x.strip())), "string")
        known = known.unionByName(short_names.where("given_name is not null and short_name is not null").select(fold_udf("short_name").alias("token"), fold_udf("given_name").alias("given")).distinct())
    alts = materialize(known.where("token <> given").distinct(), f"{tag}-short")
    marks = materialize(token_marks(tokens.where("not caps").select("token").distinct(), close, roots, alts), f"{tag}-marks")
    held = rooted.join(anchors.select("name_id", F.col("anchor").alias("root"), F.col("firm").alias("anchor")), ["name_id", "root"], "left").withColumn("anchor", F.coalesce("anchor", F.lit(0)))
    told = materialize(held.join(marks, "token", "left").groupBy("name_id").agg(F.collect_list(F.struct("token", "root", "df", "anchor", "marks")).alias("told")), f"{tag}-told")
    keys = parsed.select("name_id", "tokens", "letters").join(told, "name_id", "left").mapInPandas(_keyed, "name_id bigint, key string, flags int")
    keyed = materialize(keys.unionByName(_one_letter_off(parsed)).select(F.hex(F.xxhash64("key")).alias("key"), "name_id", "flags"), f"{tag}-keyed")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.bit_or("flags").alias("all")).where(f"size > 1 and all = {EVERY}").select("key", "size")
    keys = materialize(keyed.join(shared, "key"), f"{tag}-keys")
    discard(keyed)
    root_map = rooted.where("token <> root").groupBy("name_id").agg(F.map_from_entries(F.collect_set(F.struct("token", "root"))).alias("rmap"))
    alt_map = rooted.join(alts, "token").groupBy("name_id", "token").agg(F.collect_set("given").alias("given")).groupBy("name_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "given"))).alias("alts"))
    info = parsed.join(root_map, "name_id", "left").join(alt_map, "name_id", "left").join(told.select("name_id", F.transform(F.filter("told", lambda e: e["anchor"] > 0), lambda e: F.struct(e["token"].alias("token"), e["anchor"].alias("anchor"))).alias("anchors")), "name_id", "left")
    plain = lambda t: F.regexp_replace(t, "^-", "")
    info = info.select("name_id", "tokens", "letters", F.transform("tokens", lambda t: F.coalesce(F.try_element_at("rmap", plain(t)), plain(t))).alias("roots"), F.map_entries("alts").alias("alts"), "anchors", (F.length("letters") * 1000 + F.least(F.col("n"), F.lit(999))).alias("fullness"))
    info = materialize(info.withColumn("alts", F.transform("alts", lambda e: F.struct(e["key"].alias("token"), e["value"].alias("given")))), f"{tag}-info")

    whole = keys.where(F.col("size") <= SALT_ROWS).join(info, "name_id").repartition("key").sortWithinPartitions("key", F.desc("fullness"), "name_id")
    links = whole.select("key", "name_id", "flags", "tokens", "letters", "roots", "alts", "anchors").mapInPandas(_followers, "a bigint, b bigint")
    large = keys.where(F.col("size") > SALT_ROWS)
    if not large.isEmpty():
        links = links.unionByName(_tiled(large, info))
    links = links.distinct()
    group = components(links, tag)
    return parsed.select("name_id", "name", "n").join(group.select(F.col("node").alias("name_id"), "component"), "name_id", "left").select("name", "n", "name_id", F.coalesce("component", "name_id").alias("author"))


def same_pairs(groups: DataFrame, member: str, group: str) -> DataFrame:
    """(x, y), x < y: all pairs of members of one group, block by block, so that a
    group of any size is spread over tasks."""
    sized = groups.select(F.col(group).alias("g"), F.col(member).alias("m"))
    counts = sized.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("g", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    placed = sized.join(counts, "g").withColumn("block", F.pmod(F.xxhash64("m"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = placed.select("g", F.col("m").alias("x"), F.col("block").alias("i"), every.alias("j"))
    right = placed.select("g", F.col("m").alias("y"), F.col("block").alias("j"), every.alias("i"))
    return left.join(right, ["g", "i", "j"]).where("x < y").select("x", "y")


def _authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authors(distinct_names(spark, sf_dir), table(spark, sf_dir, "short_names"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of different strings that name the same author."""
    return same_pairs(_authors(spark, sf_dir), "name", "author").select(F.col("x").alias("name_a"), F.col("y").alias("name_b"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per spelling: its author's commonest spelling, and how often each occurs."""
    a = _authors(spark, sf_dir)
    head = a.groupBy("author").agg(F.max(F.struct("n", "name")).alias("m"), F.count(F.lit(1)).alias("n_spellings"))
    return a.join(head, "author").select("name", "n", F.col("m.name").alias("author_name"), "n_spellings")


def queries():
    return {"p3_found": p3_found, "p3_groups": p3_groups}


def oracle_sql():
    return {}
