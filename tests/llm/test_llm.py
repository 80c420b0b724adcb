import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bags, components, consensus, crosssplit, leakage, matching, names, neardup, packing, quality, topn

rng = random.Random(5)
VOCABULARY = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(3000)]


def text(n, seed):
    r = random.Random(seed)
    return [r.choice(VOCABULARY) for _ in range(n)]


def edited(words, n, seed):
    r = random.Random(seed)
    out = list(words)
    for i in r.sample(range(len(out)), n):
        out[i] = r.choice(VOCABULARY)
    r.shuffle(out)
    return out


def overlap(a, b):
    x, y = Counter(a), Counter(b)
    return sum((x & y).values()) / max(len(a), len(b))


# --- top N ----------------------------------------------------------------------------------


def test_top_n_against_brute_force(spark):
    r = random.Random(1)
    rows = [(r.choice(["g1", "g1", "g1", "g2", None]), f"id{r.randint(0, 40)}", r.choice([0.5, 1.0, 1.0, 2.0, None, float("nan"), -1.0]), "x") for _ in range(3000)] + [("g3", None, 1.0, "x")]
    df = spark.createDataFrame(rows, "g string, id string, s double, score string").repartition(5)
    got = {(x.g, x.id, x["rank"]) for x in topn.top_n(df, ["g"], "id", "s", 7).collect()}
    best = {}
    for g, i, s, _ in rows:
        if g is not None and i is not None and s is not None and s == s:
            best[g, i] = max(s, best.get((g, i), -9))
    want = set()
    for g in {k[0] for k in best}:
        for n, (i, _) in enumerate(sorted(((i, s) for (h, i), s in best.items() if h == g), key=lambda t: (-t[1], t[0]))[:7]):
            want.add((g, i, n + 1))
    assert got == want


def test_top_n_bounded_state(spark, monkeypatch):
    monkeypatch.setattr(topn, "STEP_ROWS", 50)
    monkeypatch.setattr(topn, "STATE_ROWS", 60)
    df = spark.range(4000).select((F.col("id") % 40).cast("string").alias("g"), F.col("id").cast("string").alias("i"), (F.col("id") % 97).cast("double").alias("s"))
    assert topn.top_n(df, ["g"], "i", "s", 3).count() == 120


def test_top_n_empty(spark):
    assert topn.top_n(spark.createDataFrame([], "g string, i string, s double"), ["g"], "i", "s", 3).count() == 0


# --- near duplicates ------------------------------------------------------------------------


def near_texts():
    out = []
    for g in range(12):
        base = text(rng.randint(30, 120), g)
        out.append(base)
        for e in range(rng.randint(0, 4)):
            out.append(edited(base, int(len(base) * rng.choice([0.05, 0.15, 0.19, 0.3])), 100 * g + e))
    return [" ".join(t) for t in out]


def test_near_pairs_against_brute_force(spark):
    texts = near_texts() + ["", "...", "one"]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)] + [("n", None), ("copy", texts[0])], "key string, text string")
    d = bags.bags(docs, F.col("key"), F.col("text")).cache()
    cls = bags.classes(d, "t")
    held = {r.uid: r.key for r in neardup._members(d, cls).collect() if r.key != "copy"}
    got = {frozenset((held[r.a], held[r.b])) for r in neardup.near_pairs(cls).collect()}
    want = {frozenset((f"d{i}", f"d{j}")) for i, j in itertools.combinations(range(len(texts)), 2) if texts[i].split() and texts[j].split() and re.findall(r"\w+", texts[i]) and overlap(texts[i].split(), texts[j].split()) >= 0.8}
    assert got == want and len(want) > 5


def test_sketch_agrees_with_jaccard():
    steps = neardup.probes(1120, 96)
    a, b = np.arange(1, 101, dtype=np.uint64), np.arange(34, 134, dtype=np.uint64)
    a, b = np.sort(neardup.mix(a)), np.sort(neardup.mix(b))
    x, y, z = neardup.one_permutation(np.concatenate([a, b, a[:1]]), np.array([0, 100, 200, 201]), 1120, steps)
    assert abs(np.mean(x == y) - 67 / 133) < 0.12
    assert (neardup.one_permutation(b, np.array([0, 100]), 1120, steps)[0] == y).all()  # neighbours don't matter
    assert (z != 0).all()  # a set of one element fills every bin


def test_elements_count_repeats():
    offsets, values = bags.elements(["a b a", "B, a-A", "", "x_y ß é1", "a b"])
    sets = [set(values[i:j].tolist()) for i, j in zip(offsets, offsets[1:])]
    assert [len(x) for x in sets] == [3, 3, 0, 4, 2] and sets[0] == sets[1] and len(sets[0] & sets[4]) == 2


def test_blocks_complete_large_stars(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    stars = spark.range(1, 41).select(F.lit(0).cast("bigint").alias("a"), F.col("id").alias("b"))
    assert neardup.completed(stars).count() == 40 * 39 // 2
    sides = spark.range(0, 41).select(F.col("id").alias("uid"), F.when(F.col("id") <= 10, 1).otherwise(2).alias("side"))
    assert neardup.completed(stars, sides).count() == 10 * 30


def test_stars_need_the_wanted_sides(spark):
    signed = spark.createDataFrame([(1, [7, 8], 1), (2, [7], 1), (3, [8, 9], 2), (4, [8], 1), (5, [9], 2)], "uid bigint, keys array<bigint>, side int")
    assert {tuple(r) for r in neardup.star_edges(signed).collect()} == {(1, 2), (1, 3), (1, 4), (3, 5)}
    assert {tuple(r) for r in neardup.star_edges(signed, "sides = 3").collect()} == {(1, 3), (1, 4)}


def test_one_boilerplate_bucket(spark):
    """Many copies with small edits in one bucket, in both splits."""
    base = text(40, 5)
    rows = [(f"{i}", " ".join(base[:39] + [VOCABULARY[i]])) for i in range(60)]
    d = bags.bags(spark.createDataFrame(rows, "key string, text string"), F.col("key"), F.col("text"))
    cls = bags.classes(d, "boiler")
    sides = cls.select("uid", (F.col("uid") % 3 == 0).alias("train"), (F.col("uid") % 3 != 0).alias("held"))
    n = {r.train: r["count"] for r in sides.groupBy("train").count().collect()}
    assert crosssplit.cross_pairs(cls, sides).count() == n[True] * n[False]


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.component for r in components.components(e, "t").collect()}
    assert len(got) == 33 and {got[i] for i in range(31)} == {0} and got[101] == 100
    assert components.components(spark.createDataFrame([], "a bigint, b bigint"), "t").count() == 0


# --- cross-split overlaps -------------------------------------------------------------------


def test_cross_splits_against_brute_force(spark, folder):
    texts = near_texts()
    r = random.Random(3)
    rows = [(i, r.choice(["W1", " w1 ", f"W{i}", None]), t, r.choice(["train", "dev", "test", None]), "s", None) for i, t in enumerate(texts)] + [(900, "x/W1", None, "train", None, None), (901, "W1", None, "dev", None, None), (902, "Q", "", "dev", None, None)]
    d = folder(queries=spark.createDataFrame(rows, "query_no bigint, _id string, text string, split string, source string, domain string"))
    got = {(x.query_no_a, x.query_no_b) for x in crosssplit.p7_found(spark, d).collect()}
    clean = lambda s: s and s.strip(" \t").split("/")[-1].upper()
    want = set()
    for a, b in itertools.combinations(rows, 2):
        if a[3] and b[3] and (a[3] == "train") != (b[3] == "train"):
            if (a[1] is not None and clean(a[1]) == clean(b[1])) or (a[2] and b[2] and overlap(a[2].split(), b[2].split()) >= 0.8):
                want.add((min(a[0], b[0]), max(a[0], b[0])))
    assert got == want and want


# --- consensus ------------------------------------------------------------------------------


def votes(spark, n=400):
    r = random.Random(9)
    truth = {f"S{i}": r.choice([0, 0, 1, 2, 3]) for i in range(n)}
    skill = {"good": 0.92, "fair": 0.8, "weak": 0.6}
    rows = []
    for i, (s, t) in enumerate(truth.items()):
        for m, p in skill.items():
            rows.append((len(rows), s, "D", m, t if r.random() < p else r.randint(0, 3)))
        rows.append((len(rows), s, "D", "noise", r.randint(0, 3)))
        rows.append((len(rows), s, "D", "stuck", 1))
    return truth, rows


LABELS = "label_id bigint, statement_id string, doc_id string, consensus_score int, individual_scores map<string,int>, examiner_agrees boolean"
JUDGED = "judgment_id bigint, statement_id string, doc_id string, model string, relevance_score int"


def test_consensus_held_out_accuracy(spark, folder):
    truth, rows = votes(spark)
    rows += [(9000, None, "D", "good", 1), (9001, "S0", "D", None, 2), (9002, "S1", "D", "good", 9), (9003, "S2", "D", "good", None)]
    d = folder(relevance_judgments=spark.createDataFrame(rows, JUDGED), consensus_labels=spark.createDataFrame([(1, " x/s3 ", "d", 2, None, True), (2, "L", "D", 3, None, None), (3, "E", None, 1, {"good": 1}, None)], LABELS))
    got = {r.statement_id: r.relevance_score for r in consensus.p5_found(spark, d).collect()}
    right = sum(got[s] == t for s, t in truth.items()) / len(truth)
    majority = sum(Counter(x[4] for x in rows if x[1] == s and x[4] in (0, 1, 2, 3)).most_common(1)[0][0] == t for s, t in truth.items()) / len(truth)
    assert right > majority and right > 0.9
    assert got["L"] == 3 and set(got) == set(truth) | {"L"}
    rel = {r.annotator: r.reliability for r in consensus.p5_annotators(spark, d).collect()}
    assert rel["good"] > rel["fair"] > rel["weak"] > rel["noise"]


def test_consensus_of_nothing(spark, folder):
    d = folder(relevance_judgments=spark.createDataFrame([], JUDGED), consensus_labels=spark.createDataFrame([], LABELS))
    assert consensus.p5_found(spark, d).count() == 0


# --- names ----------------------------------------------------------------------------------


def test_tokens_and_alignment():
    agree = lambda a, b: names.agreement(*(names.parse(x)[0] for x in (a, b)), *(names.parse(x)[1] for x in (a, b)), {}, {}) > 0
    assert agree("Mirabeth A. Bersirmujal", "M. A. Bersirmujal") and agree("Ranbasjaspas MJ", "Mirabeth J. Ranbasjaspas")
    assert agree("BENROLARFIS, L.", "Leodan Benrolarfis") and agree("Bepoljesbá, K", "Kelvan L. Bepoljesba")
    assert agree("IPC, Bakelsongar", "Institute for Peptide Craft, Bakelsongar") and agree("Inst Pept Craft Rilpolnulnal", "Institute for Peptide Craft, Rilpolnulnal")
    assert not agree("Hadrik Barmarbeme", "Dorvald Barmarbeme") and not agree("Ilmar Balmusdulpos", "Ilmar B. Vurdangarjal")
    assert not agree("Bakelsongar Therapeutics Company", "Institute for Peptide Craft, Bakelsongar") and not agree("F. Volventoster", "Volventoster JF")


def test_near_is_one_edit():
    assert names.near("abcd", "abdc") and names.near("abcd", "abd") and names.near("abcd", "xbcd") and names.near("abc", "abcd")
    assert not names.near("abcd", "badc") and not names.near("abcd", "ab")


def test_names_groups(spark, folder):
    cites = [(["Leodan O. Rinmuskirha", "L. Rinmuskirha", None, "  "], "Leo Rinmuskirha; Rimnuskirha L et al: A title"), (None, '"Quoted title" Journal'), ([], None), (["Falk Tupollonhis", "TUPOLLONHIS, F.", "Hadrik Tupollonhis"], "")]
    d = folder(parsed_citations=spark.createDataFrame(cites, "authors array<string>, raw_text string"), short_names=spark.createDataFrame([("Leodan", "Leo"), (None, "x")], "given_name string, short_name string"))
    got = {(r.name_a, r.name_b) for r in names.p3_found(spark, d).collect()}
    leo = sorted(["Leodan O. Rinmuskirha", "L. Rinmuskirha", "Leo Rinmuskirha", "Rimnuskirha L"])
    assert got == set(itertools.combinations(leo, 2)) | {tuple(sorted(("Falk Tupollonhis", "TUPOLLONHIS, F.")))}


# --- matching -------------------------------------------------------------------------------

CITED = "citation_id bigint, patent_id string, title string, authors array<string>, journal string, year int, raw_text string"
PAPERS = "paper_id string, title string, authors array<string>, journal string, publication_date string"


def test_matching(spark, folder):
    p = [("W1", "Rapid filtration of Leldinrase from human enterocytes", ["Olvira Zobasbodan"], "Archives of Peptide Dynamics", "2005-03-01"), ("W2", "Role of Henhermide in colitis", ["Hadrik Barmarbeme", "Calliste Zintesrerne"], "Letters on Toxin Studies", "2009"), ("W3", None, None, None, None)]
    p += [(f"X{i}", " ".join(text(7, i)), [f"{VOCABULARY[i]} {VOCABULARY[i + 1]}"], "Notes", str(1990 + i % 30)) for i in range(60)]
    c = [(1, "P", "Re: rapid filtration of Leldinrase from human enterocytse", ["Zobasbodan, O."], "Arch. Pept. Dyn.", 2005, None), (1, "P", "Re: rapid filtration of Leldinrase from human enterocytse", ["Zobasbodan, O."], "Arch. Pept. Dyn.", 2005, None)]
    c += [(2, "P", None, ["H Barmarbeme", "Zintesrerne C"], "Lett Tox Stud", 2009, None), (3, "Q", "Something else entirely about other matters", ["Nobody Known"], "Other", 1950, None), (4, "Q", None, None, None, None, None)]
    d = folder(papers=spark.createDataFrame(p + p[:2], PAPERS), parsed_citations=spark.createDataFrame(c, CITED))
    assert {(r.citation_id, r.paper_id) for r in matching.p1_found(spark, d).collect()} == {(1, "W1"), (2, "W2")}


OFTEN = ["colitis", "saliva", "enterocytes"]


def often(n=120):
    """Papers that share the frequent title words, two each, and nothing else."""
    return [(f"F{i}", f"{OFTEN[i % 3]} {OFTEN[(i + 1) % 3]} " + " ".join(text(5, 500 + i)), [f"Author{VOCABULARY[i]}"], f"Notes {i}", str(1950 + i % 20)) for i in range(n)]


def test_matching_by_frequent_words(spark, folder):
    """Title words of more than RARE papers count together with an author, or with journal and year."""
    p = [("W1", "Colitis saliva enterocytes Leldinrase", ["Olvira Zobasbodan"], "Archives of Peptide Dynamics", "2005-03-01"), ("W2", "Colitis saliva enterocytes Henhermide", ["Hadrik Barmarbeme"], "Letters on Toxin Studies", "2009")]
    c = [(1, "P", "Colitis saliva enterocytes", ["Zobasbodna, O."], "Arch. Pept. Dyn.", 2004, None), (2, "Q", "Colitis saliva enterocytes", ["H Barmarbeme"], None, 2014, None)]
    d = folder(papers=spark.createDataFrame(p + often(), PAPERS), parsed_citations=spark.createDataFrame(c, CITED))
    assert {(r.citation_id, r.paper_id) for r in matching.p1_found(spark, d).collect()} == {(1, "W1"), (2, "W2")}


def test_matching_by_frequent_words_alone(spark, folder):
    """A title of words that are all in more than RARE papers finds its paper without author, journal and year."""
    p = [("W1", "Colitis saliva enterocytes", ["Olvira Zobasbodan"], "Archives of Peptide Dynamics", "2005"), ("W2", "Sepsis", None, None, None)]
    more = [(f"S{i}", f"Sepsis x{i}", None, None, None) for i in range(45)]
    c = [(1, "P", "Colitis saliva enterocytes", None, None, None, None), (2, "Q", "colitis saliva", None, None, None, None), (3, "R", "Sepsis", None, None, None, None)]
    d = folder(papers=spark.createDataFrame(p + more + often(), PAPERS), parsed_citations=spark.createDataFrame(c, CITED))
    cit, pap = matching.records(matching._citations(spark, d), matching._papers(spark, d))
    pairs = matching.weighted(cit, pap)[2]
    got = {(r.a, r.b) for r in pairs.join(cit.select(F.col("n").alias("c"), F.col("id").alias("a")), "c").join(pap.select(F.col("n").alias("p"), F.col("id").alias("b")), "p").collect()}
    assert {("1", "W1"), ("2", "W1"), ("3", "W2")} <= got
    assert ("1", "W1") in {(str(r.citation_id), r.paper_id) for r in matching.p1_found(spark, d).collect()}


def test_matching_without_title(spark, folder):
    """Author and year, author and journal, or authors alone suffice, whatever a damaged field says."""
    six = [f"{g} {s}" for g, s in zip(["Olvira", "Hadrik", "Calliste", "Gerwald", "Lucella", "Silvane"], ["Zobasbodan", "Barmarbeme", "Zintesrerne", "Pospolporpon", "Sofurnanze", "Haszasperji"])]
    p = [("W1", "Rapid filtration of Leldinrase", ["Rosalka Zilbenbundin", "Valdemar Konkinkenkan"], "Journal of Ligand Craft", "2022"), ("W2", "Role of Henhermide", six, "Notes", "2009"), ("W3", "Uses of Tengosane", ["Kelvan Ralhorvallor", "Brunella Selropurpas", "Jorund Vusfukilpen", "Ottmar Gulbenrostan"], "Archives of Peptide Dynamics", "2001")]
    c = [(1, "P", None, ["R. Zilbenbundin", "V. Konkinkenkan"], "Journa lof Ligand Craft", 2022, None), (2, "Q", None, six, None, None, None), (3, "R", None, ["Kelvan Ralhorvallor", "Brunella Selropurpas", "Jorund Vusfukilpen", "Ottmar Gulbenrostan"], "Arch. Pept. Dyn.", 2003, None)]
    d = folder(papers=spark.createDataFrame(p, PAPERS), parsed_citations=spark.createDataFrame(c, CITED))
    assert {(r.citation_id, r.paper_id) for r in matching.p1_found(spark, d).collect()} == {(1, "W1"), (2, "W2"), (3, "W3")}


def test_matching_with_slips_in_author_and_journal(spark, folder):
    """A misspelt surname with a journal slip, or with a year far off, doesn't rule a pair out."""
    p = [("W1", "High-affinity lysate of Velrusgurycin for the treatment of colitis", ["Pellian Zajirulfin"], "Journal of Ligand Craft", "1993"), ("W2", "Rapid filtration of Leldinrase from human enterocytes", ["Olvira Zobasbodan"], "Archives of Peptide Dynamics", "2005")]
    c = [(1, "P", "high-affinity lysate of velrusgurycin for the treatment of colitis", ["Zajriulfin, Pellian"], "Journal of LigandC raft", 1993, None), (2, "Q", "Rapid filtration of Leldinrase from human enterocytes", ["Zobasbodna, Olvira"], "Archives of Peptide Dynamics", 2009, None)]
    d = folder(papers=spark.createDataFrame(p, PAPERS), parsed_citations=spark.createDataFrame(c, CITED))
    assert {(r.citation_id, r.paper_id) for r in matching.p1_found(spark, d).collect()} == {(1, "W1"), (2, "W2")}


def test_title_bound_holds():
    r = random.Random(5)
    one = lambda: " ".join(f"{w} {r.randint(1, 900)}" for w in sorted({"".join(r.choice("ab") for _ in range(r.randint(1, 7))) for _ in range(r.randint(1, 5))}))
    cts, pts = [one() for _ in range(300)], [one() for _ in range(200)]
    a, b = np.array([r.randrange(300) for _ in range(3000)]), np.array([r.randrange(200) for _ in range(3000)])
    most, back = matching.at_most(cts, pts, a, b)
    for i, j, m, k in zip(a, b, most, back):
        t, u, _ = matching.title_similarity(*matching._read_title(cts[i]), *matching._read_title(pts[j]))
        assert t <= m + 1e-9 and u <= k + 1e-9


def test_authors_that_may_agree():
    """No author is found that the bound rules out."""
    r = random.Random(8)
    first = ["Maria", "Mario", "M.", "Jo", "Johan", "Johann", "J. K.", "Ana-Maria", "Abcd", "Acbd", "ETH", "Li"]
    last = ["Smith", "Smyth", "Zilbenbundin", "Zilbenbunidn", "Kelmor", "Kim", "Abcd", "Acbd", "Eidgen Tech Hochsch"]
    name = lambda: " ".join(names.parse(f"{r.choice(first)} {r.choice(last)}")[0])
    for _ in range(3000):
        a, b = ([name() for _ in range(r.randint(1, 4))] for _ in range(2))
        used = 0
        free = list(b)
        for t in a:  # without the bound: agreement name by name
            hit = next((u for u in free if names.agreement(t.split(), u.split(), "".join(t.split()), "".join(u.split()), {}, {}) > 0 or matching._same_surname(t.split(), u.split())), None)
            if hit is not None:
                free.remove(hit)
                used += 1
        assert used <= matching.may_agree("|".join(a), "|".join(b))
        assert matching.author_similarity(a, b, {})[0] == used


def test_bound_of_log_odds():
    """The columns bound every pair's log odds, whatever its authors."""
    nan = float("nan")
    for title in (None, (0.3, 0.5, 7.0), (0.95, 0.9, 1.0)):
        for people in (0, 1, 3, 9):
            for journal in (None, 0.0, 0.85):
                for year in (None, 0, 1, 2, 9):
                    top = matching.best_odds(np.array([title[0] if title else 0]), np.array([title[1] if title else 0]), np.array([title is not None]), np.array([people]), np.array([nan if journal is None else journal]), np.array([nan if year is None else year]))[0]
                    for n in range(people + 1):
                        assert matching.log_odds(title, (n, people, people) if people else None, journal, year) <= top + 1e-9


def test_sketches_leave_every_match_open():
    """Bounds from sketches rule out no pair that the texts keep, count no fewer authors, and rule out most of the others."""
    r = random.Random(12)
    first = ["Olvira", "Hadrik", "O.", "Calliste", "ETH", "Li", "Ana-Maria", "Verenka"]
    last = ["Zobasbodan", "Zobasbodna", "Barmarbeme", "Barmarbme", "Zintesrerne", "Kim", "Abcd", "Acbd", "Eidgen Tech Hochsch", "Vander Berg", "Vanderberg", "Gosvirnelhas-Rasmer"]
    words = [(w, r.randint(100, 900)) for w in ["colitis", "colitsi", "saliva", "salivary", "of", "the", "enterocytes", "enterocyte", "leldinrase", "henhermide", "assay", "asay", "sepsis", "septic", "ab12"] + VOCABULARY[:40]]
    title = lambda: r.choice([None, " ".join(f"{w} {v}" for w, v in r.sample(words, r.randint(1, 9)))] + 6 * [" ".join(f"{w} {v}" for w, v in r.sample(words, r.randint(2, 9)))])
    people = lambda: "|".join(" ".join(names.parse(f"{r.choice(first)} {r.choice(last)}")[0]) for _ in range(r.choice([0, 1, 2, 3, 4, 30]))) or None
    journal = lambda: r.choice([None, "", "archives of peptide dynamics", "arch. pept. dyn.", "letters on toxin studies", "lett tox stud", "notes"])
    rows = [(k, k, title(), people(), journal(), r.choice([None, 1999, 2000, 2009]), title(), people(), journal(), r.choice([None, 2000, 2001, 2011])) for k in range(6000)]
    for k in range(0, 6000, 3):  # true cases among them
        rows[k] = (*rows[k][:6], *rows[k][2:6])
    columns = list(zip(*rows))
    kinds = ["int64", "int64", "string", "string", "string", "int64", "string", "string", "string", "int64"]
    b = dict(zip(["c", "p", "ct", "cn", "cj", "cy", "pt", "pn", "pj", "py"], (pa.array(x, k) for x, k in zip(columns, kinds))))
    sketched = {"cf": pa.array([matching.sketch(x[2], x[3], 0) for x in rows], pa.binary()), "pf": pa.array([matching.sketch(x[6], x[7], 65535) for x in rows], pa.binary())}
    batch = pa.RecordBatch.from_pydict(b | sketched)
    kept = {c: agree for part in (batch.slice(0, 2500), batch.slice(2500)) for out in matching._open(iter([part])) for c, agree in zip(out.column("c").to_pylist(), out.column("agree").to_pylist())}
    true = set()
    for k, _, ct, cn, cj, cy, pt, pn, pj, py in rows:
        t = matching.title_similarity(*matching._read_title(ct), *matching._read_title(pt)) if ct and pt else None
        a = matching.author_similarity(cn.split("|"), pn.split("|"), {}) if cn and pn else None
        j = matching.journal_similarity(matching.journal_words(cj), matching.journal_key(cj), matching.journal_words(pj), matching.journal_key(pj))
        s = matching.log_odds(t, a, j, None if cy is None or py is None else abs(cy - py))
        if s > matching.MIN_LOG_ODDS:
            true.add(k)
            assert k in kept and (a is None or a[0] <= kept[k])
    assert len(true) > 1000 and len(kept) < 5000


def test_bounds_of_long_words_and_capitals():
    """Words with a common ending, and names of which one has capitals, count as alike only if they may be."""
    r = random.Random(3)

    def bound(ct, cn, pt, pn):
        c, p = (matching.Sketches(pa.array([1]), pa.array([matching.sketch(t, n, blank)], pa.binary()), pa.array([None], pa.string()), pa.array([2000]), blank) for t, n, blank in ((ct, cn, 0), (pt, pn, 65535)))
        at = np.array([0])
        return matching.titles_at_most(c, p, at, at)[0][0], matching.names_at_most(c, p, at, at)[0]

    assert bound("halikulase 500", "sulvinbardo dn*", "purbarraase 500", "perrine henduzensu") == (0, 0)
    assert bound("halikulase 500", "eth*", "hailkulase 500", "eidgen tech hochsch") == (1, 1)
    assert bound("of 500", "eidgen tech hochsch", "of 500", "eth*") == (1, 1)
    for _ in range(2000):
        w = "".join(r.choice("abcdefgh") for _ in range(r.randint(4, 13)))
        k = r.randrange(len(w) - 1)
        u = r.choice([w[:k] + w[k + 1 :], w[:k] + "z" + w[k + 1 :], w[:k] + "z" + w[k:], w[:k] + w[k + 1] + w[k] + w[k + 2 :], w + "s"])
        t = matching.title_similarity([w], [5.0], [u], [5.0])[0]
        assert t <= bound(f"{w} 500", None, f"{u} 500", None)[0]


def test_meetings_by_author_are_complete(spark, folder):
    """Every pair that shares an author with the year, the journal or a second author, and isn't ruled out, is met, wherever its records are."""
    r = random.Random(4)
    last = [f"{v}on" for v in VOCABULARY[:25] if len(v) > 3]
    one = lambda: (" ".join(r.sample(VOCABULARY, 4)), [f"Olvira {x}" for x in r.sample(last, 3)], r.choice([None, "Notes", "Letters on Toxin Studies"]), r.choice([None, 2000, 2001, 2009]))
    p = [(f"W{i}", t, a, j, y and str(y)) for i in range(80) for t, a, j, y in [one()]]
    c = [(i, "P", None if i % 2 else t, a, j, y, None) for i in range(80) for t, a, j, y in [one()]]
    d = folder(papers=spark.createDataFrame(p, PAPERS), parsed_citations=spark.createDataFrame(c, CITED))
    cs, ps, _, readings, _ = matching.weighted(*matching.records(matching._citations(spark, d), matching._papers(spark, d)))
    met = {(x.c, x.p) for x in matching.candidates(cs, ps, readings).collect()}
    wanted = 0
    for x in cs.collect():
        for y in ps.collect():
            both = len(set(x.ckeys) & set(y.pkeys))
            year = None if x.cy is None or y.py is None else abs(x.cy - y.py)
            if both > 1 or (both and ((year is not None and year < 2) or (x.ck and x.ck == y.pk))):
                t = matching.title_similarity(*matching._read_title(x.ct), *matching._read_title(y.pt)) if x.ct else None
                a = matching.author_similarity(x.cn.split("|"), y.pn.split("|"), {})
                j = None if not (x.cj and y.pj) else matching.journal_similarity(matching.journal_words(x.cj), x.ck, matching.journal_words(y.pj), y.pk)
                if matching.log_odds(t, a, j, year) > matching.MIN_LOG_ODDS:
                    wanted += 1
                    assert (x.c, y.p) in met
    assert wanted > 50


def test_propagation_keeps_one_paper(spark):
    pairs = spark.createDataFrame([(1, 1, "P", 4.0), (1, 2, "P", 2.0), (2, 2, "P", 3.0), (3, 3, None, -1.0)], "c bigint, p bigint, patent string, s double")
    got = {(r.c, r.p): r.confidence for r in matching.propagate(pairs).collect()}
    assert got[1, 1] > 0.8 and got[1, 2] < 0.2 and got[2, 2] > 0.8 and abs(got[3, 3] - 1 / (1 + np.e)) < 1e-6


def test_strict_propagation(spark):
    """With an infinite cost a patent cites a paper once; with the soft one a repeat only costs."""
    pairs = spark.createDataFrame([(1, 1, "P", 6.0), (2, 1, "P", 5.0)], "c bigint, p bigint, patent string, s double")
    soft = {r.c: r.confidence for r in matching.propagate(pairs).collect()}
    strict = {r.c: r.confidence for r in matching.propagate(pairs, repeat=float("inf")).collect()}
    assert soft[2] > 0.8 and strict[2] < 0.3 and strict[1] > 0.7 and strict[1] + strict[2] <= 1.01


def test_matching_of_nothing(spark, folder):
    d = folder(papers=spark.createDataFrame([], PAPERS), parsed_citations=spark.createDataFrame([], CITED))
    assert matching.p1_found(spark, d).count() == 0


# --- packing --------------------------------------------------------------------------------


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_packing_is_whole_and_within_capacity(spark, score):
    r = random.Random(2)
    counts = spark.createDataFrame([(i, r.choice([0, 1, 5, 40, 300, 999, 1024, 5000])) for i in range(800)], "doc_id bigint, tokens bigint")
    kinds = spark.createDataFrame([("a", 1024), ("b", 4096), ("c", None), (None, 5)], "container_kind string, capacity_tokens int")
    items = packing.pieces(counts, kinds)
    got = packing.fill(items, score).toPandas()
    want = items.toPandas()
    key = ["container_kind", "doc_id", "piece", "tokens"]
    assert sorted(map(tuple, got[key].values)) == sorted(map(tuple, want[key].values))
    per = got.groupby(["container_kind", "capacity", "container_id"]).tokens.sum().reset_index()
    assert (per.tokens <= per.capacity).all()
    for kind, g in per.groupby("container_kind"):
        assert g.tokens.sum() / g.capacity.sum() > 0.85
    n = got.groupby(["container_kind", "capacity", "container_id"]).size().reset_index(name="n")
    assert (n.n <= n.capacity // packing.LEAST_AVERAGE).all()
    cost = got.assign(c=got.tokens.astype(float) ** 2).groupby(["capacity", "container_id"]).c.agg(["sum", "size"]).reset_index()
    assert (cost["sum"][cost["size"] > 1] <= packing.ATTENTION * cost.capacity[cost["size"] > 1] ** 2 + 1e-6).all()
    cut = got[got.piece > 0]
    assert set(cut.doc_id) <= {r.doc_id for r in counts.where("tokens > 1024").collect()}


def test_attention_capacity_binds():
    sizes = np.array([90, 90, 60, 60, 10, 10, 10, 10])
    loose = packing.pack(sizes, 100, attention=1.0)
    tight = packing.pack(sizes, 100, attention=0.4)
    assert loose.max() + 1 == 4 and len({tight[0], tight[1]}) == 2
    for b in set(tight):
        held = sizes[tight == b]
        assert len(held) == 1 or (held**2).sum() <= 0.4 * 100**2 and held.sum() <= 100
    assert {len(sizes[tight == tight[k]]) for k in (0, 1)} == {1}  # a piece of 90 costs more than 0.4 alone


def test_token_slices(spark):
    pytest.importorskip("tiktoken")
    try:
        enc = packing._tokenizer(packing.VOCABULARY)
    except OSError:
        pytest.skip("no vocabulary here")
    for t in (" ".join(text(30_000, 3)), "x" * 1000, "", "a  b\n\n c "):
        assert packing.count_tokens(enc, t) == len(enc.encode_ordinary(t))


def test_packing_nothing(spark):
    e = spark.createDataFrame([], "doc_id bigint, tokens bigint")
    assert packing.fill(packing.pieces(e, spark.createDataFrame([("a", 10)], "container_kind string, capacity_tokens int"))).count() == 0


# --- leaks ----------------------------------------------------------------------------------


def test_leaks(spark):
    items = [(i, " ".join(text(60, 1000 + i))) for i in range(30)]
    w = items[3][1].split()
    filler = lambda s: " ".join(text(80, s))
    changed = w[:25]
    changed[7] = changed[16] = "other"
    docs = {
        1: filler(1) + " " + items[0][1].upper() + ". " + filler(2),
        2: filler(3) + " " + " ".join(changed) + " " + filler(4),
        3: filler(5) + " " + " ".join(w[5:16]) + " " + filler(6) + " " + " ".join(w[30:42]) + " " + filler(7),
        4: filler(8) + " See also " + " ".join(w[10:17]) + " as claimed.",
        5: filler(9) + " " + "".join(f"{x} [{i}] " if i % 4 == 0 else f"<b>{x}</b>&nbsp;" for i, x in enumerate(w)),
        6: filler(10),
        7: " ".join(reversed(w)),
        8: None,
        9: "  ",
    }
    d = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    i = spark.createDataFrame(items + [(99, None), (98, " ")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(d, i).collect()}
    assert got == {(1, 0), (2, 3), (3, 3), (5, 3)}


def test_multi_index_finds_all_within_radius():
    r = np.random.default_rng(0)
    ix = leakage.ItemIndex([(k, " ".join(text(n, k))) for k, n in enumerate([40] * 20 + [120] * 5 + [3])], {}, np.empty(0, np.uint64))
    assert set(ix.by_size) == {3, 5, 8}
    for size, (prints, *_) in ix.by_size.items():
        probe = prints[:200] ^ np.array([sum(1 << int(b) for b in r.choice(64, r.integers(0, 4), replace=False)) for _ in prints[:200]], dtype=np.uint64)
        at, entry = ix.seeds(probe, size)
        found = set(zip(at.tolist(), entry.tolist()))
        want = {(i, j) for i in range(len(probe)) for j in np.flatnonzero(np.bitwise_count(probe[i] ^ prints) <= leakage.RADIUS).tolist()}
        assert found == want


@pytest.mark.parametrize("window", [1, 2, 3, 5, 8, 13, 21])
def test_simhash_is_the_majority_of_bits(window):
    bits = np.random.default_rng(window).integers(0, 1 << 63, 60, dtype=np.uint64)
    got = leakage.simhashes(bits, window)
    ones = np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(int)
    want = [ones[k : k + window].sum(axis=0) * 2 > window for k in range(60 - window + 1)]
    assert (np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool) == np.array(want)).all()


def test_stretches_beyond_repeats():
    """A weaker stretch is found though a stronger one stands in the document six times."""
    item = [f"word{i}" for i in range(30)]
    doc = [w for k in range(6) for w in item[:10] + [f"other{k}x{i}" for i in range(30)]] + item[20:26]
    got = leakage.stretches(item, np.ones(30), doc)
    assert sorted((a, z) for a, z, *_ in got) == [(0, 9)] * 6 + [(20, 25)]


def test_stock_sentences_weigh_nothing():
    item = "in one embodiment the method of claim one comprises a zirvane that is heated to ninety degrees".split()
    doc = "in one embodiment the method of claim one comprises a kelmor that is heated to ninety degrees".split()
    weight = np.array([1.0 if w == "zirvane" else 0.0 for w in item])
    assert leakage.stretches(item, weight, item) and not leakage.stretches(item, weight, doc)


def test_leaks_do_not_depend_on_blocks(spark, data):
    """All items at once, and in blocks of about forty and a hundred; stock phrases are known from all items."""
    d, i = (spark.read.parquet(f"{data}/{t}.parquet").cache() for t in ("documents", "eval_items"))
    w = d.where("length(text) < 5000").limit(30).withColumn("text", F.lit("In one embodiment, the method comprises the step of heating, and the method further comprises the step of cooling."))
    d = d.unionByName(w)
    want = sorted(map(tuple, leakage.leaks(d, i).collect()))
    assert want
    for most in (4_400, 11_000):
        assert sorted(map(tuple, leakage.leaks(d, i, block_words=most).collect())) == want


def test_short_items(spark):
    d = spark.createDataFrame([(1, "they saw Zirvane Kelmor there"), (2, "nothing here")], "doc_id bigint, text string")
    i = spark.createDataFrame([(1, "Zirvane Kelmor")], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(d, i).collect()} == set()  # two words are no stretch: the least chain weighs 4
    i = spark.createDataFrame([(1, "saw Zirvane Kelmor")], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(d, i).collect()} == {(1, 1)}


def test_leaks_of_nothing(spark):
    e, n = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert leakage.leaks(e, n).count() == 0


# --- quality --------------------------------------------------------------------------------

COMMON = frozenset("the of and a in to was with for is by as at that on were".split())
WORDS = pa.array(sorted(COMMON), pa.large_string())
PROSE = "The samples were measured at noon and the result was written down. A second run with the same device gave the same value. It was repeated on two days."


@pytest.mark.parametrize(
    "body, prose",
    [
        (PROSE, True),
        (PROSE.upper(), True),
        ("\n".join(re.findall(r".{1,40}(?: |$)", PROSE)), True),
        ("1. " + PROSE.replace(". ", ".\n2. "), True),
        ("\n".join(f"{i}\t{i * 3}\tname{i}" for i in range(30)), False),
        ("\n".join(f"- item {i}" for i in range(30)), False),
        ("Home\nSearch\nLogin\n" * 10, False),
        ("QmFzZTY0IGRhdGEgaXMgbm90IHByb3NlIGF0IGFsbA" * 8, False),
        (" ".join(random.Random(1).sample((PROSE + " ") .replace(".", "").split() * 6, 100)), False),
        ("The same sentence stands here again. " * 20, False),
        (PROSE + "\n\n" + "\n".join(f"{i},{i * 7},{i * 5},x" for i in range(200)), False),
    ],
)
def test_prose_or_not(body, prose):
    (share,), (reason,) = quality.verdicts([body], WORDS)
    assert (share >= 0.5) == prose and (prose or reason)


def test_verdicts_do_not_depend_on_neighbours():
    bodies = ["", PROSE, "- a\n- b\n\n" + PROSE, "\n\n", "a,b,c,d\ne,f,g,h", "Menu\nHome\nLogin\nSearch", PROSE.replace("noon", "n\u00adoon") + "\n", "x" * 30, PROSE + "\n" + "1\t2\t3\n" * 50] * 2
    together = quality.verdicts(bodies, WORDS)
    for k, b in enumerate(bodies):
        (share,), (reason,) = quality.verdicts([b], WORDS)
        assert (share, reason) == (together[0][k], together[1][k])


def test_quality_edges(spark):
    d = spark.createDataFrame([(1, None), (2, " \n "), (3, PROSE), (4, PROSE * 2000)], "doc_id bigint, text string")
    w = spark.createDataFrame([("en", x, 1) for x in COMMON] + [("en", None, 2)], "lang string, word string, word_rank int")
    assert {r.doc_id for r in quality.prose_share(d, w).collect()} == {3, 4}
    s = {r.doc_id: r for r in quality.failures(quality.statistics(d, w)).collect()}
    assert s[3].n_words == 29 and "word_count" in s[3].failed and s[2].n_words == 0
    assert quality.prose_share(d.limit(0), w).count() == 0


def test_assignment_is_optimal():
    r = random.Random(4)
    pool = ["maria", "mario", "m", "johan", "johann", "smith", "smyth", "s", "kelmor", "kelmer", "k"]
    for _ in range(300):
        x, y = ([r.choice(pool) for _ in range(r.randint(1, 4))] for _ in range(2))
        best = 0.0
        for p in itertools.permutations([*range(len(y)), *[None] * len(x)], len(x)):
            got = sum(v - 0.001 * abs(i - j) for i, j in enumerate(p) if j is not None and (v := names.token_score(x[i], y[j], {}, {})) > 0)
            best = max(best, got)
        m = names.assign(x, y, {}, {})
        assert abs(sum(v - 0.001 * abs(i - j) for i, j, v in m) - best) < 1e-9
        assert len({i for i, *_ in m}) == len({j for _, j, _ in m}) == len(m)


@pytest.mark.parametrize("rows", [3, 1000])
def test_names_in_blocks_of_any_size(spark, monkeypatch, rows):
    """The groups are the same if every block is cut into salts of three, whose leaders don't shrink, as if it is one."""
    monkeypatch.setattr(names, "SALT_ROWS", rows)
    given = ["Albert", "Bernard", "Cornelia", "Dorothea", "Emilio", "Friedrich", "Gwendolyn", "Heloise"]
    spell = lambda g: [f"{g} Zilbenbundin", f"Zilbenbundin, {g}", f"{g} Zilbenbunidn", f"{g.upper()} ZILBENBUNDIN"]
    rows_ = spark.createDataFrame([(n, 1) for g in given for n in spell(g)], "name string, n bigint")
    got = {}
    for r in names.authors(rows_).collect():
        got.setdefault(r.author, set()).add(r.name)
    assert sorted(map(sorted, got.values())) == sorted(sorted(spell(g)) for g in given)


def test_names_that_share_no_rare_word_meet(spark):
    """Spellings that agree are compared whatever the frequency of the words they share, misspelt ones too."""
    others = [f"{g} Kolp" for g in ("Albert", "Cornelia", "Dorothea", "Emilio", "Friedrich", "Heloise")] + [f"Annemarie {w}" for w in ("Zilben", "Mornak", "Fusgal", "Tirdol", "Venhas", "Rospun", "Galmir")]
    pairs = [("Bernadottina Kolp", "B. Kolp"), ("Annemarie Gupta", "Annemarie Gupat"), ("Annemarie T. Stolzenberg", "Stolzenbreg A")]
    rows = spark.createDataFrame([(n, 1) for n in [*others, *itertools.chain(*pairs)]], "name string, n bigint")
    got = {r.name: r.author for r in names.authors(rows).collect()}
    assert all(got[a] == got[b] for a, b in pairs)
    assert len({got[n] for n in others} | {got[a] for a, _ in pairs}) == len(others) + len(pairs)


def test_name_blocks_hold_every_agreeing_pair(spark):
    """Every two names that agree, by brute force, share a block that compares them."""
    r = random.Random(11)
    given, last = ["Maria", "Mario", "Johan", "Jon", "Kelvan", "Norvin", "Corvin"], ["Smith", "Smyth", "Kelmor", "Tol", "Tolgar", "Institute", "Corvin"]
    one = lambda w: r.choice([w, w, w[0] + ".", w[:3], w[:2].upper()])
    every = sorted({f"{one(r.choice(given))} {one(r.choice(last))}" + r.choice(["", "", f" {one(r.choice(given + last))}", f"-{r.choice(last)}"]) for _ in range(250)})
    parsed = [names.parse(n) for n in every]
    words = {t.strip("-*") for p, _ in parsed for t in p if not t.endswith("*")}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    close = names.near_tokens(frame([(i, t) for i, t in enumerate(sorted(words))], "name_id bigint, token string"))
    alts = [("jon", "johan"), ("tol", "maria")]
    found = names.token_marks(frame([(t,) for t in words], "token string"), close, frame([], "token string, root string"), frame(alts, "token string, given string"))
    marks = {m.token: [tuple(e) for e in m.marks] for m in found.collect()}
    given_of = {a: {g for b, g in alts if a == b} for a, _ in alts}
    df = Counter(t.strip("-*") for p, _ in parsed for t in p)
    told, firm, keys = {}, [], []
    for p, letters in parsed:
        long = [t.strip("-") for t in p if len(t.strip("-*")) > 3 and not t.endswith("*")]
        firm.append({t: 2 for t in long if df[t] == min(df[u] for u in long)})
        told = {t.strip("-*"): (t.strip("-*"), df[t.strip("-*")], firm[-1].get(t.strip("-*"), 0), marks.get(t.strip("-*"), [])) for t in p}
        keys.append(names._name_keys(p, letters, told))
    n = 0
    for i, j in itertools.combinations(range(len(every)), 2):
        (a, sa), (b, sb) = parsed[i], parsed[j]
        if names.agreement(a, b, sa, sb, {}, given_of, (firm[i], firm[j])) > 0 and not names.near(sa, sb):
            n += 1
            assert any(names._met(keys[i][k], keys[j][k]) for k in keys[i].keys() & keys[j].keys()), (every[i], every[j])
    assert n > 100


def test_sql(spark, data):
    from test_core import same

    import __spark_entry__ as entry
    from plumbline import llm

    for m in llm.modules():
        for name in m.oracle_sql():
            assert name in entry.queries()
            same(spark, data, name)


def test_clashing_columns_and_nulls_everywhere(spark, folder):
    """Inputs with columns named as the operators' own, and rows of nulls alone."""
    hits = "query_id string, subject_id string, bit_score double, search string, hit_id string, id string, g0 string, rank int"
    chem = "query_id string, chemical_id string, similarity double, score double"
    d = folder(blast_hits=spark.createDataFrame([("q", "a", 1.0, "x", "y", "z", "w", 5), (None,) * 8], hits), chemical_hits=spark.createDataFrame([("q", "c", 0.5, 9.0), (None,) * 4], chem))
    assert {tuple(r) for r in topn.p6_found(spark, d).collect()} == {("blast", "q", "a"), ("chemical", "q", "c")}


def test_corpus_with_clashing_columns(spark, folder):
    t = " ".join(text(50, 77))
    rows = [("A", "t", t, 1, "k", "f"), ("B", "t", t, 2, "k", "f"), (None, None, None, None, None, None), ("C", "", t, 3, "", ""), ("D", "t", None, 4, "", "")]
    d = folder(corpus=spark.createDataFrame(rows, "_id string, title string, text string, uid int, key string, fp string"))
    assert [tuple(r) for r in neardup.p4_found(spark, d).collect()] == [("A", "B")]
    assert {(r.doc_id, r.group_id, r.group_size) for r in neardup.p4_groups(spark, d).collect()} == {("A", "A", 2), ("B", "A", 2)}


def test_empty_corpus_and_queries(spark, folder):
    d = folder(corpus=spark.createDataFrame([], "_id string, title string, text string"), queries=spark.createDataFrame([], "query_no bigint, _id string, text string, split string, source string"))
    assert neardup.p4_found(spark, d).count() == 0 and crosssplit.p7_found(spark, d).count() == 0


def test_names_of_nothing(spark, folder):
    d = folder(parsed_citations=spark.createDataFrame([(None, None)], "authors array<string>, raw_text string"), short_names=spark.createDataFrame([], "given_name string, short_name string"))
    assert names.p3_found(spark, d).count() == 0
