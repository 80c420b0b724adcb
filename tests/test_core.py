import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plumbline.functions import citations, dates, ids
from plumbline.functions.text import clean_id, words
from plumbline.operators import analyses, grading, orphan_queries, orphans, ranking, retrieval, stats
from plumbline.operators.metrics import per_query
from plumbline.plans.shared import discard, materialize
from plumbline.plans.sizing import maybe_broadcast, small
from plumbline.sources import records


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()[0]


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_clean_id(spark):
    assert one(spark, "\t https://x.org/w12 ", clean_id) == "W12"
    assert one(spark, None, clean_id) is None
    assert one(spark, "  ", clean_id) == ""


def test_words(spark):
    assert one(spark, "Ab-c1 é_x", words) == ["ab", "c1", "é", "x"]


@pytest.mark.parametrize(
    "given, parts",
    [("US 1,234,567", ("US", "1234567", None)), ("EP 1234567 A1", ("EP", "1234567", "A1")), ("WO 2020/123456", ("WO", "2020123456", None)), ("us0012345b2", ("US", "12345", "B2")), ("", ("UNKNOWN", "", None)), (None, ("UNKNOWN", "", None))],
)
def test_patent_ids(spark, given, parts):
    assert tuple(one(spark, given, ids.patent)) == parts


def test_patent_full_form(spark):
    assert one(spark, "US1234567B2", lambda c: ids.formatted(ids.patent(c), "full")) == "US 1,234,567 B2"


@pytest.mark.parametrize("text, parent", [("The method of claim 1, wherein x", 1), ("A composition according to claim 5", 5), ("A method of treating", None), ("as in claim 7, wherein", 7)])
def test_parent_claim(spark, text, parent):
    assert one(spark, text, citations.parent_claim) == parent


@pytest.mark.parametrize("text, numbers", [("Claims 1-3, 5 and 7", [1, 2, 3, 5, 7]), ("claim 4", [4]), ("no number", []), ("Claims 9-7", [])])
def test_claim_numbers(spark, text, numbers):
    assert one(spark, text, citations.claim_numbers) == numbers


@pytest.mark.parametrize("text, day", [("2010-02-03", "2010-02-03"), ("2010/02/03", "2010-02-03"), ("20100203", "2010-02-03"), ("2010", "2010-01-01"), ("2010-05", "2010-05-01"), ("2010-02-31", None), ("soon", None), (None, None)])
def test_dates(spark, text, day):
    got = one(spark, text, dates.parse_date)
    assert (got and got.isoformat()) == day


def test_temporal_modes(spark):
    df = spark.createDataFrame([("2010-01-01", "2011-01-01"), ("2011-01-01", "2011-01-01"), (None, "2011-01-01")], "p string, q string")
    got = {m: [r[0] for r in df.select(dates.precedes(F.col("p"), F.col("q"), m)).collect()] for m in ("invalid", "drop", "keep")}
    assert got == {"invalid": [True, False, False], "drop": [True, False, None], "keep": [True, False, True]}


T = lambda day: datetime(2024, 1, day)
REFS = "ref_table string, row_id bigint, target string, key string, at timestamp"
LIVES = "target string, key string, live_from timestamp, live_until timestamp"


def orphan_case(spark):
    lives = spark.createDataFrame([("t", "A", T(5), T(10)), ("t", "A", T(12), None), ("t", "B", T(3), T(3)), ("t", "C", T(1), T(4)), ("t", "C", T(2), T(6))], LIVES).where("live_until is null or live_until > live_from")
    refs = spark.createDataFrame([("r", i, "t", k, T(d)) for i, (k, d) in enumerate([("A", 4), ("A", 5), ("A", 9), ("A", 10), ("A", 13), ("B", 3), ("C", 5), ("C", 6), ("D", 1)])], REFS)
    return refs, lives


def test_orphans_at_once(spark):
    refs, lives = orphan_case(spark)
    more, _ = orphans.advance(orphans.OrphanState.empty(spark), refs, lives)
    assert {r.row_id for r in more.found.where("orphan").collect()} == {0, 3, 5, 7, 8}


def test_orphans_in_increments(spark):
    refs, lives = orphan_case(spark)
    state, got, moved, lo = orphans.OrphanState.empty(spark), set(), [], 0
    for hi in (5, 9, 11, 31):
        batch = refs.where(f"day(at) > {lo} and day(at) <= {hi}")
        arrived = lives.where(f"day(live_from) > {lo} and day(live_from) <= {hi}")
        more, turned = orphans.advance(state, batch, arrived, T(hi) + timedelta(days=1))
        more = more.kept()
        moved += [(hi, r.row_id, r.waiting) for r in turned.collect()]
        got |= {r.row_id for r in more.found.where("orphan").collect()}
        state, lo = state.plus(more), hi
        assert {tuple(r) for r in state.compacted().waiting().collect()} == {tuple(r) for r in state.waiting().collect()}
    assert got == {0, 3, 5, 7, 8}
    # C dies on the 6th, A on the 10th and lives again from the 12th
    assert sorted(moved) == [(9, 6, True), (11, 0, True), (11, 1, True), (11, 2, True), (31, 0, False), (31, 1, False), (31, 2, False), (31, 3, False)]
    assert {r.row_id for r in state.waiting().collect()} == {5, 6, 7, 8}


@pytest.mark.parametrize("unit", ["quarter", "year"])
def test_orphans_do_not_depend_on_batches(spark, data, unit):
    refs, held = orphan_queries._inputs(spark, data)
    out, steps = None, None
    for state, more, _, _ in orphans.batches(refs.where("year(at) >= 2025"), held.where("year(live_from) >= 2025"), unit):
        out = more.found if out is None else out.unionByName(more.found)
        step = orphans.waiting_counts(state, more, more.now)
        steps = step if steps is None else steps.unionByName(step)
    more, _ = orphans.advance(orphans.OrphanState.empty(spark), refs.where("year(at) >= 2025"), held.where("year(live_from) >= 2025"))
    rows = lambda d: sorted(map(tuple, d.select("ref_table", "row_id", "key", "at", "orphan").collect()))
    assert rows(out) == rows(more.found)
    once = orphans.running(orphans.steps(more.found, more.now, "month"))
    many = orphans.running(steps.groupBy("ref_table", "period").agg(F.sum("step").alias("step")))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, many.collect()))


def test_orphans_of_nothing(spark):
    e = orphans.OrphanState.empty(spark)
    more, turned = orphans.advance(e, spark.createDataFrame([], REFS), spark.createDataFrame([], LIVES))
    assert more.found.count() == 0 and turned.count() == 0
    assert list(orphans.batches(spark.createDataFrame([], REFS), spark.createDataFrame([], LIVES))) == []


def test_split_covers_and_is_disjoint(spark):
    df = spark.createDataFrame([(f"q{i}", "abc"[i % 3] if i < 97 else "small") for i in range(99)], "id string, s string")
    got = ranking.split_by_share(df, "id", "s").collect()
    assert len(got) == 99 and len({r.id for r in got}) == 99
    assert {r.split for r in got if r.s == "small"} == {"train"}
    again = ranking.split_by_share(df.repartition(7), "id", "s").collect()
    assert {(r.id, r.split) for r in got} == {(r.id, r.split) for r in again}


def test_metrics_bounds_and_hand_values(spark):
    run = spark.createDataFrame([("s", "q", d, sc) for d, sc in (("a", 3.0), ("b", 2.0), ("c", 1.0))], "system string, query_id string, doc_id string, score double")
    qrels = spark.createDataFrame([("q", "a", 1), ("q", "c", 1), ("x", "a", 1)], "query_id string, doc_id string, relevance int")
    got = {r.query_id: r for r in per_query(run, qrels, [2]).collect()}
    assert got["q"].p_2 == 0.5 and got["q"].r_2 == 0.5 and abs(got["q"].ap - (1 + 2 / 3) / 2) < 1e-9 and got["q"].rr == 1
    assert got["x"].ap == 0
    assert "x" not in {r.query_id for r in per_query(run, qrels, [2], universe="intersect").collect()}


def test_kappa_perfect_and_constant(spark):
    df = spark.createDataFrame([("p", i % 4, i % 4) for i in range(8)] + [("c", 1, 1)] * 3, "m string, a int, b int")
    got = {r.m: r.kappa for r in stats.kappa(df, "a", "b", ["m"]).collect()}
    assert got == {"p": 1.0, "c": 0.0}


def test_t_p_value():
    assert abs(stats.t_p_value(2.262157, 10) - 0.05) < 1e-5
    assert abs(stats.t_p_value(0.0, 10) - 1.0) < 1e-9


def test_bootstrap_is_reproducible():
    import numpy as np

    v = np.arange(20) / 20
    assert stats.bootstrap(v, 500) == stats.bootstrap(v, 500)
    m, lo, hi = stats.bootstrap(v, 500)
    assert lo < m < hi
    assert stats.bootstrap(np.ones(5), 100)[1:] == (1.0, 1.0)


def test_every_judged_pair_has_a_domain(spark, folder):
    q = [("A", ["C07K14/05", "A61"]), ("A", []), ("B", ["G01N33/5"]), ("C", None)]
    p = [("W1", [("https://openalex.org/C55493867",)]), ("W2", [("C10",)]), ("W3", None)]
    l = [("A", "W1", 3), ("A", "W2", 0), ("B", "W2", 1), ("B", "W3", 2), ("C", "W1", 1), ("X", "W1", 1), (" A", "X ", 2)]
    d = folder(queries=spark.createDataFrame(q, "_id string, ipc_codes array<string>"), papers=spark.createDataFrame(p, "paper_id string, concepts array<struct<id: string>>"), consensus_labels=spark.createDataFrame(l, "statement_id string, doc_id string, consensus_score int"))
    got = {(r.query_id, r.doc_id): r.domain_type for r in entry.queries()["join_domain_overlap"](spark, d).collect()}
    assert {k for k, v in got.items() if v == "IN"} == {("A", "W1"), ("B", "W2")} and len(got) == 7


def test_booted_takes_the_default_draws():
    import numpy as np
    import pandas as pd

    v = np.random.RandomState(2).rand(40)
    got = stats._booted(["system"], "x")(pd.DataFrame({"system": "a", "query_id": [f"{i:02}" for i in range(40)], "x": v})).iloc[0]
    assert (got["mean"], got["lower"], got["upper"]) == stats.bootstrap(v, 10_000)


def test_shared_tables(spark):
    df = materialize(spark.range(10), "test")
    assert df.count() == 10 and small(df)
    assert "ResolvedHint (strategy=broadcast)" in maybe_broadcast(df)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in maybe_broadcast(df, 1)._jdf.queryExecution().analyzed().toString()
    by = materialize(spark.range(10).withColumn("k", F.col("id") % 3), "test", "k")
    assert by.where("k = 1").count() == 3 and by.columns == ["id", "k"]
    discard(df)
    discard(by)


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from plumbline.plans.shared import shared_dir

    conf = SimpleNamespace(get=lambda *_: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)))


def test_kendall_against_pairs():
    r = np.random.RandomState(3)
    for n in (1, 2, 3, 7, 40):
        for top in (2, 5, 100):
            x, y = r.randint(0, top, n), r.randint(0, top, n)
            s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(n) for j in range(i))
            a, b = (sum(v[i] != v[j] for i in range(n) for j in range(i)) for v in (x, y))
            assert abs(analyses.tau_b(x, y) - (s / (a * b) ** 0.5 if a * b else 0)) < 1e-9


def test_boot_classes():
    cells = np.array([[30, 5, 0, 0], [2, 20, 3, 0], [0, 4, 10, 1], [0, 0, 2, 8]])
    got = analyses.boot_classes(cells, 2000).set_index("measure")
    assert abs(got.value["accuracy"] - 68 / 85) < 1e-9 and (got.lower < got.value).all() and (got.value < got.upper).all()
    assert analyses.boot_classes(np.diag([3, 3, 3, 3]), 100).upper.tolist()[:1] == [1.0]
    assert analyses.boot_classes(np.zeros((4, 4), int), 10).value.tolist() == [0, 0, 0]


def test_hash_rank_is_the_rank(spark):
    df = spark.createDataFrame([(f"k{i}", None if i % 7 == 0 else f"g{i % 3}") for i in range(500)], "k string, g string")
    w = Window.partitionBy("g").orderBy(*ranking.hash_order("k", 9))
    want = {r.k: (r.r, r.n) for r in df.select("k", F.row_number().over(w).alias("r"), F.count("*").over(Window.partitionBy("g")).alias("n")).collect()}
    assert {r.k: (r._r, r._n) for r in ranking.hash_ranked(df, "g", "k", 9).collect()} == want


def test_moving_percentiles_in_blocks(spark, monkeypatch):
    r = np.random.RandomState(1)
    rows = [(g, i, float(r.randint(0, 50))) for g, m in (("a", 300), ("b", 7), (None, 40)) for i in range(m)]
    df = spark.createDataFrame(rows, "g string, i bigint, v double").repartition(5)
    monkeypatch.setattr(ranking, "MOVING_BLOCK", 25)
    got = {(x.g, x.i): (x.n, x.q) for x in ranking.moving_percentiles(df, "g", "i", "v", (0.05, 0.95), 20).collect()}
    assert len(got) == len(rows)
    for g in ("a", "b", None):
        v = [x[2] for x in rows if x[0] == g]
        for i in range(len(v)):
            n, q = got[g, i]
            before = v[max(0, i - 20) : i]
            assert n == len(before) and (not before or np.allclose(q, np.percentile(before, [5, 95])))


def test_matrix_gives_the_same_ranking(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{data}/eval_items.parquet").where("item_id % 4 = 0").select(F.col("item_id").alias("query_id"), "text")
    want = ranking.ranked(retrieval.bm25(docs, items), ["query_id"], ranking.by_score(), 5)
    key = lambda d: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in d.collect())
    assert key(retrieval.bm25_top(docs, items, 5)) == key(want)
    monkeypatch.setattr(retrieval, "MATRIX_CELLS", 20_000)  # several blocks of queries
    assert key(retrieval.bm25_top(docs, items, 5)) == key(want)
    none = retrieval.bm25_top(docs, items.limit(0), 5)
    assert none.count() == 0 and retrieval.bm25_top(docs.limit(0), items, 5).count() == 0


@pytest.mark.parametrize("idf", ["lucene", "okapi", "sum"])
def test_blocks_give_the_same_ranking(spark, monkeypatch, idf):
    # "all" is in every document and "half" in half of them, so that shared words may add less than nothing, or nothing
    text = lambda i: " ".join(["all"] + ["half"] * (i % 2) + [f"a{i % 7}"] * (i % 3) + [f"b{i % 11}", f"c{i}"])
    docs = spark.createDataFrame([(f"d{i}", text(i)) for i in range(60)] + [("none", None), ("blank", " ")], "doc_id string, text string")
    asked = spark.createDataFrame([(f"q{i}", text(i) + " " + text(i + 5)) for i in range(25)] + [("frequent", "all"), ("half", "half half"), ("odd", "elsewhere"), ("none", None)], "query_id string, text string")
    key = lambda d: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in d.collect())
    want = key(ranking.ranked(retrieval.bm25(docs, asked, idf=idf), ["query_id"], ranking.by_score(), 5))
    assert key(retrieval.bm25_best(docs, asked, 5, idf=idf)) == want
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 9)
    monkeypatch.setattr(retrieval, "BLOCKS_A_TASK", 3)
    for share in (0.02, 1.0):  # some terms in the dense product, or none
        monkeypatch.setattr(retrieval, "DENSE_SHARE", share)
        assert key(retrieval.bm25_best(docs, asked, 5, idf=idf)) == want
    assert retrieval.bm25_best(docs, asked.limit(0), 5, idf=idf).count() == 0 and retrieval.bm25_best(docs.limit(0), asked, 5, idf=idf).count() == 0


def test_product_of_blocks_in_bounded_memory(monkeypatch):
    """Sums over shared terms are the same, and what is held at once is bounded, however many occurrences two blocks share."""
    import tracemalloc

    r = np.random.default_rng(5)
    rows, terms, each = 500, 400, 100

    def block():
        b = object.__new__(retrieval._Rows)
        b.ids, b.terms, b.starts = np.arange(rows), np.arange(terms), np.arange(rows + 1) * each
        b.u = np.concatenate([np.sort(r.choice(terms, each, replace=False)) for _ in range(rows)])
        b.row = np.repeat(np.arange(rows), each)
        return b

    q, d, none = block(), block(), np.empty(0, np.int64)
    qw, dw = r.random(rows * each), r.random(rows * each)
    x, y = np.zeros((rows, terms)), np.zeros((rows, terms))
    x[q.row, q.u], y[d.row, d.u] = qw, dw
    monkeypatch.setattr(retrieval, "SHARED_AT_ONCE", 50_000, raising=False)
    tracemalloc.start()
    got = retrieval._product(q, d, qw, dw, none)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, x @ y.T, rtol=1e-4) and peak < 20 << 20  # 6.25 million shared occurrences, 8 bytes each


@pytest.mark.parametrize("name", ["ret_bm25_okapi", "ret_bm25_demo", "ret_idf_sum", "fus_hybrid"])
def test_lexical_pairs_are_never_rows(spark, data, name):
    plan = entry.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"keys=\[q#\d+L?, doc#", plan)


def test_earlier_of_a_class_are_never_all_pairs(spark, folder):
    # 30 ids of many rows each, two of them far more than are asked for, in one class
    day = lambda i: f"{2000 + i * 7 % 20}-{1 + i % 12:02d}-01"
    rows = [(i, f"Q{i % 30 if i % 3 else i % 2}", day(i), ["A61K1/2", "A61K9/9"][: 1 + i % 2]) for i in range(400)]
    rows += [(7, "Q9", "2011-05-05", ["A61K1/2"]), (500, None, "1990-01-01", ["A61K1/2"]), (501, "Q1", None, ["A61K1/2"]), (502, "Q1", "2030-01-01", []), (503, "Q1", "2030-01-01", None)]
    d = folder(queries=spark.createDataFrame(rows, "query_no bigint, _id string, priority_date string, ipc_codes array<string>"))
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view queries as select * from '{d}/queries.parquet/*.parquet'")
    got = entry.queries()["join_ipc4_nonequi"](spark, d)
    assert "ipc4-held" in " ".join(got.inputFiles())  # of a class, only rows that can be chosen are joined
    want = con.execute(entry.oracle_sql()["join_ipc4_nonequi"]).fetchall()
    assert len(want) > 3000 and sorted(map(tuple, got.collect())) == sorted(want)


def test_query_sets_in_blocks(spark, monkeypatch):
    rows = spark.range(50).select(F.col("id").alias("doc_id"))
    asked = spark.range(9).select(F.col("id").alias("query_id"))
    monkeypatch.setattr(retrieval, "small", lambda d: False)
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 200)
    assert retrieval.against(rows, asked).distinct().count() == 450


def test_approximate_search(spark, data):
    """Every row is indexed, and recall against the exact search is 0.9 at least."""
    v = spark.read.parquet(f"{data.replace('0.001', '0.01')}/embeddings.parquet")
    _, rows = retrieval.inverted_file(v)
    assert rows.count() == v.where("embedding is not null").count()
    pair = lambda d: {(r.query_id, r.doc_id) for r in d.collect()}
    exact, got = pair(retrieval.exact_search(v, 50, 10)), pair(retrieval.approximate_search(v, 50, 10))
    assert len(exact & got) / len(exact) >= 0.9
    assert retrieval.approximate_search(v.limit(0), 50, 10).count() == 0


def test_numbers_over_ranges(spark):
    from plumbline.operators.reports import numbered

    df = spark.range(2000).select(F.format_string("id%05d", "id").alias("k")).repartition(5)
    got = [r.code for r in numbered(df, ["k"], "RN", 101).orderBy("k").collect()]
    assert got == [f"RN{n:03d}" for n in range(101, 2101)]


def test_answers_of_models(spark):
    from plumbline.operators.reports import reordered

    window = spark.createDataFrame([("q", d, k) for k, d in enumerate("abc", 1)] + [("r", "x", 1), ("s", "y", 1), ("s", "z", 2)], "query_id string, doc_id string, rank int")
    said = spark.createDataFrame([("q", '```json\n{"ranking": [3, 9, 1]}\n```'), ("r", "no"), ("s", '{"other": 1}')], "query_id string, answer string")
    got = {(r.query_id, r.doc_id): round(r.score, 4) for r in reordered(window, said).collect()}
    assert got == {("q", "c"): 1.0, ("q", "a"): 0.3333, ("r", "x"): 1.0, ("s", "y"): 1.0, ("s", "z"): 0.5}


def test_grades(spark):
    rows = [("examiner", 9, None, 2), ("examiner", 7, None, 1), ("examiner", 6, None, 0), ("applicant", 8, None, 1), ("applicant", 7, None, 0), ("office_action", 1, None, 1), ("applicant", 1, "102", 3), ("applicant", 1, "103", 2), (None, None, None, 0)]
    df = spark.createDataFrame(rows, "s string, c int, r string, want int")
    assert df.where(grading.grade(F.col("s"), F.col("c"), F.col("r")) != F.col("want")).count() == 0


def test_records_of_registers(spark):
    """Broken records give no row, a citation alone is a list of one, missing fields are empty."""
    v = lambda *x: spark.createDataFrame([(y,) for y in x], "value string")
    w = records.works(v('{"id": "https://x.example/W1", "abstract_inverted_index": {"b": [1, 3], "a": [0, 2]}}', "{", '{"title": "t"}')).collect()
    assert [(r.paper_id, r.abstract, r.title, r.doi, r.authors) for r in w] == [("W1", "a b a b", "", None, [])]
    one = '{"ops:world-patent-data":{"ops:register-search":{"reg:register-documents":{"reg:register-document":[{"reg:search-report-data":{"reg:citation":{"reg:nplcit":{"text":{"$":"T"}},"reg:rel-claims":"1-2, x, 7, 5-4"}}}]}}}}'
    got = records.search_reports(v(one, "{}", None)).collect()
    assert [(r.category, r.cited, r.is_patent, r.claims) for r in got] == [("A", "T", False, [1, 2, 7])]
    assert records.search_reports_xml(v("<a/>", '<w xmlns:e="u"><e:search-report date="d"><e:citation category="X"><e:patcit><e:document-id><e:country>EP</e:country><e:doc-number>1</e:doc-number></e:document-id></e:patcit></e:citation></e:search-report></w>')).select("cited", "category", "date").collect()[0][:] == ("EP1", "X", "d")
    assert records.alignments(v("<BlastOutput/>")).count() == 0


def test_files_against_their_manifest(spark, tmp_path):
    from plumbline.sources import files

    d, m = f"{tmp_path}/d", f"{tmp_path}/m"
    (tmp_path / "d").mkdir()
    for n in "abc":
        (tmp_path / "d" / n).write_text(n)
    files.checksums(spark, d).write.json(m)
    (tmp_path / "d" / "a").unlink(), (tmp_path / "d" / "b").write_text("x"), (tmp_path / "d" / "n").write_text("n")
    assert {r.file: r.state for r in files.verified(spark, d, m).collect()} == {"a": "missing", "b": "changed", "c": "ok", "n": "new"}


CORE = [n for n in entry.oracle_sql() if not n.startswith("p") or n.startswith("p2_") or n.startswith("prj_")]


def _normal(v):
    import math

    import numpy as np
    import pandas as pd

    if isinstance(v, (list, np.ndarray)):
        return tuple(_normal(x) for x in v)
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) if isinstance(v, (float, np.floating)) else v.item() if isinstance(v, np.generic) else v


def same(spark, data, name):
    import glob
    import os
    from collections import Counter

    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    a, b = entry.queries()[name](spark, data).toPandas(), con.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    rows = lambda d: Counter(tuple(_normal(x) for x in r) for r in d[cols].itertuples(index=False))
    assert rows(a) == rows(b)


@pytest.mark.parametrize("name", CORE)
def test_against_sql(spark, data, name):
    same(spark, data, name)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
