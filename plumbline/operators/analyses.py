"""Statistics and analyses of runs and judgments that build on the per-query metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_id
from ..plans.catalog import Catalogue, rel, withs
from ..sources.tables import table
from .fusion import _MODAL, _TYPE, trimodal
from .grading import agreed
from .metrics import _sql, means, per_query
from .ranking import by_score, ranked
from .stats import _PAIR, _booted, _pairs, differences, kappa, pearson

CAT = Catalogue()
queries, oracle_sql = CAT.queries, CAT.oracle_sql


def _per(spark, d, ks=(10,), **more) -> DataFrame:
    return per_query(rel(spark, d, "scored"), rel(spark, d, "qrels"), list(ks), **more)


# --- rank correlation ------------------------------------------------------------------------


def tau_b(x: np.ndarray, y: np.ndarray) -> float:
    """Kendall's tau-b in n log n: discordant pairs are inversions, counted by merging; 0 where a side is constant."""
    n = len(x)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    ties = lambda *cols: sum(k * (k - 1) // 2 for k in np.unique(np.stack(cols, 1), axis=0, return_counts=True)[1].tolist())
    a, b, both, every = ties(x), ties(y), ties(x, y), n * (n - 1) // 2
    ranks = np.unique(y, return_inverse=True)[1]
    inversions, width = 0, 1
    while width < n:  # blocks are sorted; elements of the right half below one of the left half are inversions
        block = np.arange(n) // (2 * width)
        left = (np.arange(n) // width) % 2 == 0
        key = block * (n + 1) + ranks
        inversions += int((np.searchsorted(key[left], (block + 1)[~left] * (n + 1), "left") - np.searchsorted(key[left], key[~left], "right")).sum()) if left.any() else 0
        ranks = ranks[np.lexsort((ranks, block))]
        width *= 2
    down = float(every - a) * float(every - b)
    return (every - a - b + both - 2 * inversions) / down**0.5 if down > 0 else 0.0


@CAT.query("st_kendall", _sql([10]) + """, m AS (SELECT a.system AS system_a, b.system AS system_b, query_id, round(a.ndcg_10, 9) AS x, round(b.ndcg_10, 9) AS y FROM per a JOIN per b USING (query_id) WHERE a.system < b.system),
c AS (SELECT u.system_a, u.system_b, sum(sign(u.x - v.x) * sign(u.y - v.y)) AS s, count(*) FILTER (WHERE u.x <> v.x)::DOUBLE AS nx, count(*) FILTER (WHERE u.y <> v.y)::DOUBLE AS ny FROM m u JOIN m v ON u.system_a = v.system_a AND u.system_b = v.system_b AND u.query_id < v.query_id GROUP BY 1, 2)
SELECT system_a, system_b, round(CASE WHEN nx * ny > 0 THEN s / sqrt(nx * ny) ELSE 0 END, 6) AS tau FROM c""")
def _kendall(spark, d):
    """Rank correlation of systems over queries; a query without hits counts 0. One number per query and pair of systems reaches the sort."""
    p = _per(spark, d).select("query_id", "system", F.round("ndcg_10", 9).alias("v"))
    a = p.select("query_id", F.col("system").alias("system_a"), F.col("v").alias("x"))
    m = a.join(p.select("query_id", F.col("system").alias("system_b"), F.col("v").alias("y")), "query_id").where("system_a < system_b")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"system_a": g["system_a"].iloc[:1], "system_b": g["system_b"].iloc[:1], "tau": [round(tau_b(g["x"].to_numpy(), g["y"].to_numpy()), 6)]})

    return m.groupBy("system_a", "system_b").applyInPandas(run, "system_a string, system_b string, tau double")


# --- classes ---------------------------------------------------------------------------------


@CAT.query("st_class_report", _PAIR + """, k AS (SELECT model, c, count(*) FILTER (WHERE a = c AND b = c)::DOUBLE AS tp, count(*) FILTER (WHERE a = c)::DOUBLE AS np, count(*) FILTER (WHERE b = c)::DOUBLE AS ng FROM p, (SELECT unnest([0, 1, 2, 3]) AS c) GROUP BY 1, 2)
SELECT model, c AS class, tp::BIGINT AS n_right, round(coalesce(tp / nullif(np, 0), 0), 6) AS precision, round(coalesce(tp / nullif(ng, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(np + ng, 0), 0), 6) AS f1, round(avg(coalesce(tp / nullif(ng, 0), 0)) OVER (PARTITION BY model), 6) AS balanced_accuracy FROM k""")
def _classes(spark, d):
    """Precision, recall and F1 per class, and balanced accuracy, from one aggregation per model."""
    p = _pairs(spark, d)
    t = p.groupBy("model").agg(*(x for k in range(4) for x in (F.count_if((F.col("a") == k) & (F.col("b") == k)).alias(f"t{k}"), F.count_if(F.col("a") == k).alias(f"p{k}"), F.count_if(F.col("b") == k).alias(f"g{k}"))))
    z = lambda x, y: F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))
    recall = [z(F.col(f"t{k}"), F.col(f"g{k}")) for k in range(4)]
    t = t.withColumn("balanced_accuracy", F.round((recall[0] + recall[1] + recall[2] + recall[3]) / 4, 6))
    row = lambda k: F.struct(F.lit(k).alias("class"), F.col(f"t{k}").alias("n_right"), F.round(z(F.col(f"t{k}"), F.col(f"p{k}")), 6).alias("precision"), F.round(recall[k], 6).alias("recall"), F.round(z(2 * F.col(f"t{k}"), F.col(f"p{k}") + F.col(f"g{k}")), 6).alias("f1"))
    return t.select("model", "balanced_accuracy", F.inline(F.array(*(row(k) for k in range(4)))))


def class_metrics(cells: np.ndarray) -> tuple[float, float, float]:
    """Accuracy, macro F1 and balanced accuracy of a table of counts (predicted, true)."""
    right, pred, true = np.diag(cells).astype(float), cells.sum(axis=1), cells.sum(axis=0)
    n = cells.sum()
    f1 = np.divide(2 * right, pred + true, out=np.zeros(len(right)), where=pred + true > 0)
    recall = np.divide(right, true, out=np.zeros(len(right)), where=true > 0)
    return (right.sum() / n if n else 0.0), float(f1.mean()), float(recall.mean())


def boot_classes(cells: np.ndarray, draws: int = 10_000, seed: int = 42) -> pd.DataFrame:
    """Percentile intervals of the three measures. Drawing n pairs with replacement is a multinomial
    draw over the table's cells, so a group is its table of counts, however many pairs it has."""
    n, k = int(cells.sum()), len(cells)
    drawn = np.random.RandomState(seed).multinomial(n, cells.ravel() / max(1, n), size=draws).reshape(draws, k, k) if n else np.zeros((1, k, k))
    got = np.array([class_metrics(c) for c in drawn])
    point = class_metrics(cells)
    lo, hi = np.percentile(got, [2.5, 97.5], axis=0)
    return pd.DataFrame({"measure": ["accuracy", "macro_f1", "balanced_accuracy"], "value": point, "lower": lo, "upper": hi})


@CAT.query("st_boot_class")
def _boot_class(spark, d):
    """Bootstrap intervals of accuracy, macro F1 and balanced accuracy per model; 10,000 draws, seed 42."""
    cells = _pairs(spark, d).groupBy("model", "a", "b").agg(F.count(F.lit(1)).alias("n"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        t = np.zeros((4, 4), dtype=np.int64)
        t[g["a"].to_numpy(), g["b"].to_numpy()] = g["n"].to_numpy()
        return boot_classes(t).assign(model=g["model"].iloc[0])[["model", "measure", "value", "lower", "upper"]]

    return cells.groupBy("model").applyInPandas(run, "model string, measure string, value double, lower double, upper double")


@CAT.query("st_agreement", "SELECT count(*) AS n_items, round(avg((agreement = 'unanimous')::INT), 6) AS unanimous, round(avg((agreement = 'majority')::INT), 6) AS majority, round(avg(examiner::INT), 6) AS examiner_agreement FROM (SELECT min(agreement) AS agreement, bool_and(examiner_agrees) AS examiner FROM consensus_labels WHERE agreement IS NOT NULL AND statement_id IS NOT NULL AND doc_id IS NOT NULL GROUP BY clean_id(statement_id), clean_id(doc_id))")
def _agreement(spark, d):
    """Shares of items by agreement, and of compared items on which the examiner agrees."""
    c = table(spark, d, "consensus_labels").where("agreement is not null and statement_id is not null and doc_id is not null")
    i = c.groupBy(clean_id("statement_id"), clean_id("doc_id")).agg(F.min("agreement").alias("a"), F.bool_and("examiner_agrees").alias("x"))
    share = lambda k: F.round(F.avg((F.col("a") == k).cast("int")), 6)
    return i.agg(F.count(F.lit(1)).alias("n_items"), share("unanimous").alias("unanimous"), share("majority").alias("majority"), F.round(F.avg(F.col("x").cast("int")), 6).alias("examiner_agreement"))


# --- slices and tables -----------------------------------------------------------------------


@CAT.query("abl_domain", _sql([10]).replace("rq AS (SELECT * FROM qrels WHERE relevance >= 1)", f"qt AS (SELECT clean_id(_id) AS query_id, list_transform(flatten(list(ipc_codes)), lambda c: CASE WHEN regexp_matches(c, '^.{{3}}[A-Za-z]') THEN substr(c, 1, 4) ELSE substr(c, 1, 3) END) AS a FROM queries WHERE _id IS NOT NULL AND ipc_codes IS NOT NULL GROUP BY 1), rq AS (SELECT q.* FROM qrels q JOIN qt USING (query_id) WHERE relevance >= 1 AND list_contains(a, 'A61K'))") + "SELECT system, count(*) AS n_queries, round(avg(ndcg_10), 6) AS ndcg_10, round(avg(r_10), 6) AS r_10 FROM per GROUP BY 1")
def _abl_domain(spark, d):
    """Metrics on the judgments of one class of queries."""
    code = F.col("c")
    cls = F.when(code.rlike("^.{3}[A-Za-z]"), F.substring(code, 1, 4)).otherwise(F.substring(code, 1, 3))
    some = table(spark, d, "queries").where("_id is not null").select(clean_id("_id").alias("query_id"), F.explode("ipc_codes").alias("c")).where(cls == "A61K").select("query_id")
    q = rel(spark, d, "qrels").join(some, "query_id", "left_semi")
    per = per_query(rel(spark, d, "scored"), q, [10])
    return per.groupBy("system").agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("ndcg_10"), 6).alias("ndcg_10"), F.round(F.avg("r_10"), 6).alias("r_10"))


@CAT.query("met_simple", _sql([5, 10]) + "SELECT system, round(avg(p_5), 6) AS p_5, round(avg(r_5), 6) AS r_5, round(avg(p_10), 6) AS p_10, round(avg(r_10), 6) AS r_10 FROM per GROUP BY 1")
def _simple(spark, d):
    return means(_per(spark, d, (5, 10)), ["system"]).select("system", "p_5", "r_5", "p_10", "r_10")


_CALLS = _sql([100]) + """, cs AS (SELECT clean_id(statement_id) AS query_id, provider AS system, sum(cost_usd::DECIMAL(18,6))::DOUBLE AS cost FROM relevance_judgments WHERE statement_id IS NOT NULL AND provider IS NOT NULL GROUP BY 1, 2),
tr AS (SELECT query_id, count(*) AS n_calls, sum(cost) AS cost, min(system) AS first FROM cs GROUP BY 1), fi AS (SELECT t.query_id, count(*) FILTER (WHERE x.rank <= 5) AS h FROM tr t JOIN tops x ON x.query_id = t.query_id AND x.system = t.first JOIN rq ON rq.query_id = x.query_id AND rq.doc_id = x.doc_id GROUP BY 1),
fn AS (SELECT query_id, count(DISTINCT doc_id) AS h FROM scored SEMI JOIN rq USING (query_id, doc_id) GROUP BY 1), ef AS (SELECT t.*, coalesce(fn.h, 0)::DOUBLE / n_rel AS r, coalesce(fi.h, 0)::DOUBLE / n_rel AS r1 FROM tr t JOIN best USING (query_id) LEFT JOIN fn USING (query_id) LEFT JOIN fi USING (query_id)) """


@CAT.query("met_efficiency", _CALLS + "SELECT (SELECT round(avg(n_calls), 6) FROM tr) AS calls, (SELECT quantile_cont(n_calls::DOUBLE, 0.5) FROM tr) AS median_calls, (SELECT round(avg(cost), 6) FROM tr) AS cost, round(avg(r / n_calls), 6) AS efficiency, round(avg(CASE WHEN n_calls >= 2 THEN r - r1 END), 6) AS refinement_gain FROM ef")
def _efficiency(spark, d):
    """Systems asked per query taken as calls: recall per call, what later calls add to the first five of the first, cost."""
    s = rel(spark, d, "scored")
    q = rel(spark, d, "qrels").where("relevance >= 1")
    cost = F.sum(F.col("cost_usd").cast("decimal(18,6)")).cast("double")
    r = table(spark, d, "relevance_judgments").where("statement_id is not null and provider is not null")
    calls = r.groupBy(clean_id("statement_id").alias("query_id"), F.col("provider").alias("system")).agg(cost.alias("cost")).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_calls"), F.sum("cost").alias("cost"), F.min("system").alias("system"))
    top = ranked(s, ["system", "query_id"], by_score(), 5).join(calls.select("query_id", "system"), ["query_id", "system"]).join(q.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    first = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("h1"))
    last = s.select("query_id", "doc_id").distinct().join(q.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("h"))
    n = q.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    e = calls.join(n, "query_id", "left").join(last, "query_id", "left").join(first, "query_id", "left")
    share = lambda c: F.coalesce(c, F.lit(0)) / F.col("n")
    return e.agg(
        F.round(F.avg("n_calls"), 6).alias("calls"), F.percentile("n_calls", 0.5).alias("median_calls"), F.round(F.avg("cost"), 6).alias("cost"), F.round(F.avg(share(F.col("h")) / F.col("n_calls")), 6).alias("efficiency"),
        F.round(F.avg(F.when(F.col("n_calls") >= 2, share(F.col("h")) - share(F.col("h1")))), 6).alias("refinement_gain"),
    )


@CAT.query("an_per_domain")
def _per_domain(spark, d):
    """Bootstrap interval of mean NDCG per domain and system; a group holds one number per query."""
    per = _per(spark, d).join(rel(spark, d, "q_domain"), "query_id").select("query_id", "system", F.substring("domain", 1, 3).alias("domain"), "ndcg_10")
    return per.groupBy("domain", "system").applyInPandas(_booted(["domain", "system"], "ndcg_10"), "domain string, system string, mean double, lower double, upper double, significant boolean")


@CAT.query("an_significance")
def _significance(spark, d):
    """Pairs of systems by NDCG, and pairs of models by correctness: bootstrap of the mean difference, per tier."""
    one = differences(_per(spark, d), "ndcg_10").withColumn("tier", F.lit("retrieval"))
    right = _pairs(spark, d).groupBy("query_id", F.col("model").alias("system")).agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("v"))
    both = one.unionByName(differences(right, "v").withColumn("tier", F.lit("grading")))
    return both.groupBy("tier", "system_a", "system_b").applyInPandas(_booted(["tier", "system_a", "system_b"], "x"), "tier string, system_a string, system_b string, mean double, lower double, upper double, significant boolean")


@CAT.query("an_tables", _PAIR + """, r AS (SELECT model, b, avg((a = b)::INT) AS rec, count(*) AS n FROM p GROUP BY 1, 2), t AS (SELECT model, count(*) AS n, avg((a = b)::INT) AS acc, avg(abs(a - b)) AS err, avg(((a > 0) = (b > 0))::INT) AS bin FROM p GROUP BY 1)
SELECT model, t.n, round(acc, 4) AS accuracy, round(bal, 4) AS balanced_accuracy, round(err, 4) AS mean_error, round(bin, 4) AS binary_accuracy FROM t JOIN (SELECT model, avg(rec) AS bal FROM r GROUP BY 1) USING (model)""")
def _tables(spark, d):
    """The grading table: accuracy, accuracy balanced over the classes that occur, mean error, accuracy of the sign."""
    p = _pairs(spark, d)
    ok = (F.col("a") == F.col("b")).cast("int")
    bal = p.groupBy("model", "b").agg(F.avg(ok).alias("r")).groupBy("model").agg(F.round(F.avg("r"), 4).alias("balanced_accuracy"))
    t = p.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(ok), 4).alias("accuracy"), F.round(F.avg(F.abs(F.col("a") - F.col("b"))), 4).alias("mean_error"), F.round(F.avg(((F.col("a") > 0) == (F.col("b") > 0)).cast("int")), 4).alias("binary_accuracy"))
    return t.join(bal, "model").select("model", "n", "accuracy", "balanced_accuracy", "mean_error", "binary_accuracy")


@CAT.query("an_cost", _sql([10]) + ", c AS (SELECT provider AS system, sum(cost_usd::DECIMAL(18,6))::DOUBLE AS cost_usd FROM relevance_judgments WHERE provider IS NOT NULL GROUP BY 1), m AS (SELECT system, round(avg(r_10), 4) AS recall_10, round(avg(ndcg_10), 4) AS ndcg_10 FROM per GROUP BY 1) SELECT system, recall_10, ndcg_10, round(cost_usd, 4) AS cost_usd, round(cost_usd - coalesce(lag(cost_usd) OVER (ORDER BY cost_usd, system), 0), 4) AS incremental_cost FROM m JOIN c USING (system)")
def _cost(spark, d):
    """Quality and cost per system, dearest last, with what each costs more than the one before. One row per system reaches the window."""
    c = table(spark, d, "relevance_judgments").where("provider is not null").groupBy(F.col("provider").alias("system")).agg(F.sum(F.col("cost_usd").cast("decimal(18,6)")).cast("double").alias("cost"))
    m = _per(spark, d).groupBy("system").agg(F.round(F.avg("r_10"), 4).alias("recall_10"), F.round(F.avg("ndcg_10"), 4).alias("ndcg_10")).join(c, "system")
    before = F.lag("cost").over(Window.partitionBy(F.lit(1)).orderBy("cost", "system"))
    return m.select("system", "recall_10", "ndcg_10", F.round("cost", 4).alias("cost_usd"), F.round(F.col("cost") - F.coalesce(before, F.lit(0.0)), 4).alias("incremental_cost"))


_FAIL = _sql([10]) + ", f AS (SELECT s.system, q.query_id, q.doc_id, q.relevance, t.rank FROM rq q CROSS JOIN (SELECT DISTINCT system FROM scored) s LEFT JOIN tops t ON t.system = s.system AND t.query_id = q.query_id AND t.doc_id = q.doc_id) "


def failed(spark, d, k: int = 3) -> DataFrame:
    """Each relevant pair and system: ``rank`` (null: not retrieved) and whether it lies beyond k."""
    s = rel(spark, d, "scored")
    names = s.agg(F.collect_set("system").alias("s"))  # one row: systems are compared by name
    q = rel(spark, d, "qrels").where("relevance >= 1").crossJoin(F.broadcast(names)).select("query_id", "doc_id", "relevance", F.explode("s").alias("system"))
    top = ranked(s, ["system", "query_id"], by_score()).select("system", "query_id", "doc_id", "rank")
    return q.join(top, ["system", "query_id", "doc_id"], "left").withColumn("failed", F.coalesce(F.col("rank") > k, F.lit(True)))


@CAT.query("an_failures", _FAIL + "SELECT system, relevance, count(*) AS n_relevant, count(*) FILTER (WHERE rank IS NULL) AS not_retrieved, count(*) FILTER (WHERE rank > 3) AS low_ranked, round(count(*) FILTER (WHERE rank IS NULL OR rank > 3)::DOUBLE / count(*), 6) AS failure_rate, count(DISTINCT CASE WHEN rank IS NULL OR rank > 3 THEN query_id END) AS n_queries FROM f GROUP BY GROUPING SETS ((system), (system, relevance))")
def _failures(spark, d):
    """Failures per system, and by grade: never retrieved, ranked too low, rate, queries concerned."""
    f = failed(spark, d)
    return f.groupingSets([["system"], ["system", "relevance"]], "system", "relevance").agg(
        F.count(F.lit(1)).alias("n_relevant"), F.count_if(F.col("rank").isNull()).alias("not_retrieved"), F.count_if(F.col("rank") > 3).alias("low_ranked"), F.round(F.avg(F.col("failed").cast("int")), 6).alias("failure_rate"),
        F.count_distinct(F.when(F.col("failed"), F.col("query_id"))).alias("n_queries"),
    )


@CAT.query("top_worst_queries", _FAIL + "SELECT query_id, count(*) AS n_failures, round(count(*)::DOUBLE / any_value(n), 6) AS share FROM f JOIN (SELECT query_id, count(*) AS n FROM f GROUP BY 1) USING (query_id) WHERE rank IS NULL OR rank > 3 GROUP BY 1 ORDER BY n_failures DESC, query_id LIMIT 10")
def _worst(spark, d):
    g = failed(spark, d).groupBy("query_id").agg(F.count_if("failed").alias("n_failures"), F.round(F.avg(F.col("failed").cast("int")), 6).alias("share"))
    return g.where("n_failures > 0").orderBy(F.desc("n_failures"), "query_id").limit(10)


@CAT.query("smp_failures", _FAIL + ", q2 AS (SELECT clean_id(_id) AS query_id, min(text) AS text FROM queries WHERE text IS NOT NULL AND _id IS NOT NULL GROUP BY 1), c2 AS (SELECT clean_id(_id) AS doc_id, max(text) AS text FROM corpus WHERE _id IS NOT NULL GROUP BY 1), s2 AS (SELECT * FROM f WHERE rank IS NULL OR rank > 3 ORDER BY md5('42:' || system || ' ' || query_id || ' ' || doc_id), system, query_id, doc_id LIMIT 100) SELECT system, s2.query_id, s2.doc_id, rank, substr(coalesce(q2.text, ''), 1, 1000) AS query_text, substr(coalesce(c2.text, ''), 1, 1000) AS doc_text FROM s2 LEFT JOIN q2 USING (query_id) LEFT JOIN c2 USING (doc_id)")
def _sample(spark, d):
    """A hundred failures in hash order, with the head of both texts for reading."""
    key = F.concat_ws(" ", "system", "query_id", "doc_id")
    s = failed(spark, d).where("failed").orderBy(F.md5(F.concat(F.lit("42:"), key)), "system", "query_id", "doc_id").limit(100)
    head = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, 1000)
    j = s.join(rel(spark, d, "q1").select("query_id", F.col("text").alias("a")), "query_id", "left").join(rel(spark, d, "corpus1").select("doc_id", F.col("text").alias("b")), "doc_id", "left")
    return j.select("system", "query_id", "doc_id", "rank", head(F.col("a")).alias("query_text"), head(F.col("b")).alias("doc_text"))


# --- models against each other ---------------------------------------------------------------

_RIGHT = withs("judged", "qrels") + ", v AS (SELECT query_id, model, (avg((score = relevance)::INT) >= 0.5)::INT AS ok FROM judged JOIN qrels USING (query_id, doc_id) GROUP BY 1, 2), m AS (SELECT a.model AS model_a, b.model AS model_b, a.ok AS x, b.ok AS y FROM v a JOIN v b USING (query_id) WHERE a.model < b.model)"


def right(spark, d) -> DataFrame:
    """(query_id, model, ok): whether the model grades at least half of a query's documents as the consensus does."""
    return _pairs(spark, d).groupBy("query_id", "model").agg((F.avg((F.col("a") == F.col("b")).cast("int")) >= 0.5).cast("int").alias("ok"))


@CAT.query("an_inter_model", _RIGHT + ", s AS (SELECT model_a, model_b, count(*)::DOUBLE AS n, sum((x = y)::INT) AS same, sum(x)::DOUBLE AS sx, sum(y)::DOUBLE AS sy FROM m GROUP BY 1, 2) SELECT model_a, model_b, n::BIGINT AS n, round(same / n, 6) AS observed, round(coalesce((same / n - (sx * sy + (n - sx) * (n - sy)) / (n * n)) / nullif(1 - (sx * sy + (n - sx) * (n - sy)) / (n * n), 0), 0), 6) AS kappa FROM s")
def _inter(spark, d):
    """Pairwise agreement of models on being right, with Cohen's kappa."""
    v = right(spark, d)
    a, b = (v.select("query_id", F.col("model").alias(f"model_{k}"), F.col("ok").alias(c)) for k, c in (("a", "x"), ("b", "y")))
    m = a.join(b, "query_id").where("model_a < model_b")
    return kappa(m, "x", "y", ["model_a", "model_b"], grades=2)


@CAT.query("an_unanimous", _RIGHT + " SELECT count(*) AS n_queries, count(*) FILTER (WHERE r = n) AS all_right, count(*) FILTER (WHERE r = 0) AS all_wrong FROM (SELECT query_id, sum(ok) AS r, count(*) AS n FROM v GROUP BY 1 HAVING count(*) >= 2)")
def _unanimous(spark, d):
    q = right(spark, d).groupBy("query_id").agg(F.sum("ok").alias("r"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return q.agg(F.count(F.lit(1)).alias("n_queries"), F.count_if(F.col("r") == F.col("n")).alias("all_right"), F.count_if(F.col("r") == 0).alias("all_wrong"))


@CAT.query("an_hardest", _RIGHT + " SELECT query_id, count(*) FILTER (WHERE ok = 0) AS n_wrong, count(*) AS n_models FROM v GROUP BY 1 HAVING count(*) FILTER (WHERE ok = 0) >= 2")
def _hardest(spark, d):
    """Queries that two models or more get wrong."""
    return right(spark, d).groupBy("query_id").agg(F.count_if(F.col("ok") == 0).alias("n_wrong"), F.count(F.lit(1)).alias("n_models")).where("n_wrong >= 2")


_K = (1, 3, 5, 10, 20)


@CAT.query("an_context", withs("judged", "qrels") + """, r AS (SELECT model, query_id, score, relevance, row_number() OVER (PARTITION BY model, query_id ORDER BY md5('42:' || doc_id), doc_id) AS n FROM judged JOIN qrels USING (query_id, doc_id)), g AS (SELECT query_id, max(relevance) AS gold FROM qrels GROUP BY 1),
k AS (SELECT unnest([1, 3, 5, 10, 20]) AS k), l AS (SELECT model, query_id, k, max(score) AS label FROM r, k WHERE n <= k GROUP BY 1, 2, 3) SELECT model, k, count(*) AS n, round(avg((label = gold)::INT), 6) AS accuracy FROM l JOIN g USING (query_id) GROUP BY 1, 2""")
def _context(spark, d):
    """Accuracy of a statement's label by model and number k of documents the model saw: its highest grade among the first k."""
    j = _pairs(spark, d)
    from .ranking import hash_order

    r = ranked(j, ["model", "query_id"], hash_order("doc_id", 42), max(_K))
    l = r.groupBy("model", "query_id").agg(*(F.max(F.when(F.col("rank") <= k, F.col("a"))).alias(f"k{k}") for k in _K))
    gold = rel(spark, d, "qrels").groupBy("query_id").agg(F.max("relevance").alias("gold"))
    long = l.join(gold, "query_id").select("model", "gold", F.inline(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("label")) for k in _K))))
    return long.groupBy("model", "k").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("label") == F.col("gold")).cast("int")), 6).alias("accuracy"))


_MID = "rank() OVER (PARTITION BY {g} ORDER BY {v}) + (count(*) OVER (PARTITION BY {g}, {v}) - 1) / 2.0::DOUBLE"


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by..., n, pearson, spearman) of two columns. Ranks come from the distinct values of a group, not from its rows."""
    def mid(v: str) -> DataFrame:
        t = df.groupBy(*by, v).agg(F.count(F.lit(1)).alias("m"))
        upto = F.sum("m").over(Window.partitionBy(*by).orderBy(v))
        return t.select(*by, v, (upto - F.col("m") + (F.col("m") + 1) / F.lit(2.0)).alias(f"_r{v}"))

    j = df.join(mid(x), [*by, x]).join(mid(y), [*by, y])
    return j.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(pearson(x, y), 5).alias("pearson"), F.round(pearson(f"_r{x}", f"_r{y}"), 5).alias("spearman"))


_TC = _sql([10]) + ", a AS (SELECT provider AS system, clean_id(statement_id) AS query_id, round(avg(is_prior_art::INT), 9) AS hit FROM relevance_judgments WHERE statement_id IS NOT NULL AND is_prior_art IS NOT NULL GROUP BY 1, 2), z AS (SELECT s.system, query_id, round(r_10, 9) AS x, hit AS y FROM per JOIN a USING (system, query_id) JOIN (VALUES (system), ('all')) s(system) ON true)"


@CAT.query("an_tier_corr", _TC.replace(" JOIN (VALUES (system), ('all')) s(system) ON true)", ")").replace("SELECT s.system, query_id", "SELECT unnest([system, 'all']) AS system, query_id") + f", r AS (SELECT *, {_MID.format(g='system', v='x')} AS rx, {_MID.format(g='system', v='y')} AS ry FROM z) SELECT system, count(*) AS n, round(coalesce(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 0), 5) AS pearson, round(coalesce(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 0), 5) AS spearman FROM r GROUP BY 1")
def _tiers(spark, d):
    """Recall against correctness per query, by system and pooled."""
    j = table(spark, d, "relevance_judgments").where("statement_id is not null and is_prior_art is not null")
    a = j.groupBy(F.col("provider").alias("system"), clean_id("statement_id").alias("query_id")).agg(F.round(F.avg(F.col("is_prior_art").cast("int")), 9).alias("y"))
    z = _per(spark, d).select("system", "query_id", F.round("r_10", 9).alias("x")).join(a, ["system", "query_id"])
    return spearman(z.select(F.explode(F.array("system", F.lit("all"))).alias("system"), "x", "y"), ["system"], "x", "y")


@CAT.query("an_qualitative", withs("judged", "qrels") + ", r AS (SELECT query_id, doc_id, count(*) AS n, sum((score = relevance)::INT) AS k, count(DISTINCT score) AS kinds FROM judged JOIN qrels USING (query_id, doc_id) GROUP BY 1, 2) SELECT query_id, doc_id, CASE WHEN k = 0 THEN 'all_wrong' WHEN k = n THEN 'all_right' WHEN k = 1 THEN 'one_right' WHEN kinds >= 3 THEN 'sensitive' ELSE 'mixed' END AS kind FROM r")
def _qualitative(spark, d):
    """Items by how the models do: all wrong, all right, one right alone, answers all over, or mixed."""
    g = _pairs(spark, d).groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("k"), F.count_distinct("a").alias("kinds"))
    k = F.col("k")
    return g.select("query_id", "doc_id", F.when(k == 0, "all_wrong").when(k == F.col("n"), "all_right").when(k == 1, "one_right").when(F.col("kinds") >= 3, "sensitive").otherwise("mixed").alias("kind"))


@CAT.query("an_vocab_gap", _sql([10]) + """, q1 AS (SELECT clean_id(_id) AS query_id, min(text) AS text, min(ifnull(domain, 'unknown')) AS domain FROM queries WHERE text IS NOT NULL AND _id IS NOT NULL GROUP BY 1), c1 AS (SELECT clean_id(_id) AS doc_id, concat_ws(' ', max(title), max(text)) AS text FROM corpus WHERE _id IS NOT NULL GROUP BY 1),
o AS (SELECT query_id, any_value(domain) AS domain, avg(len(list_intersect(a, b))::DOUBLE / nullif(len(list_distinct(list_concat(a, b))), 0)) AS j FROM (SELECT q.query_id, domain, list_distinct(regexp_extract_all(lower(q1.text), '[\\p{L}\\p{N}]+')) AS a, list_distinct(regexp_extract_all(lower(c1.text), '[\\p{L}\\p{N}]+')) AS b FROM qrels q JOIN q1 USING (query_id) JOIN c1 USING (doc_id) WHERE relevance >= 1) GROUP BY 1)
SELECT system, domain, count(*) AS n, round(coalesce(covar_pop(j, ndcg_10) / nullif(stddev_pop(j) * stddev_pop(ndcg_10), 0), 0), 5) AS ndcg_10, round(coalesce(covar_pop(j, r_10) / nullif(stddev_pop(j) * stddev_pop(r_10), 0), 0), 5) AS r_10 FROM per JOIN o USING (query_id) GROUP BY GROUPING SETS ((system), (system, domain))""")
def _gap(spark, d):
    """Correlation of the overlap of words with NDCG and recall, per system and per domain."""
    from ..functions.text import words

    q = rel(spark, d, "qrels").where("relevance >= 1").select("query_id", "doc_id")
    t = q.join(rel(spark, d, "q1").select("query_id", "domain", F.array_distinct(words("text")).alias("a")), "query_id").join(rel(spark, d, "corpus1").select("doc_id", F.array_distinct(words(F.concat_ws(" ", "title", "text"))).alias("b")), "doc_id")
    j = F.try_divide(F.size(F.array_intersect("a", "b")).cast("double"), F.size(F.array_union("a", "b")).cast("double"))
    o = t.groupBy("query_id").agg(F.avg(j).alias("j"), F.min("domain").alias("domain"))
    per = _per(spark, d).join(o, "query_id")
    return per.groupingSets([["system"], ["system", "domain"]], "system", "domain").agg(F.count(F.lit(1)).alias("n"), F.round(pearson("j", "ndcg_10"), 5).alias("ndcg_10"), F.round(pearson("j", "r_10"), 5).alias("r_10"))


# --- three modalities ------------------------------------------------------------------------


_TRI = _MODAL + f""", f AS (SELECT query_id, doc_id, 0.4::DOUBLE * coalesce(x, 0) + 0.3::DOUBLE * coalesce(c, 0) + 0.3::DOUBLE * coalesce(s, 0) AS score, {_TYPE} AS match_type FROM p),
tp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM f WHERE round(score, 9) >= 0.1 QUALIFY rank <= 100), """ + withs("qrels")[5:] + """, rq AS (SELECT split_part(query_id, '-', 1) AS query_id, doc_id, max(relevance)::DOUBLE AS g FROM qrels WHERE relevance > 0 GROUP BY 1, 2),
id AS (SELECT query_id, count(*) AS n, sum(CASE WHEN r <= 10 THEN g / log2(r + 1) END) AS best FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY g DESC, doc_id) AS r FROM rq) GROUP BY 1),
ht AS (SELECT query_id, count(*) AS h, sum(CASE WHEN rank <= 10 THEN g / log2(rank + 1) END) AS d FROM tp JOIN rq USING (query_id, doc_id) GROUP BY 1),
me AS (SELECT round(avg(coalesce(d / best, 0)), 6) AS ndcg_10, round(avg(coalesce(h, 0)::DOUBLE / n), 6) AS recall_100, count(*) AS n_queries FROM id SEMI JOIN tp USING (query_id) LEFT JOIN ht USING (query_id))
SELECT match_type, count(*) AS n_hits, any_value(ndcg_10) AS ndcg_10, any_value(recall_100) AS recall_100, any_value(n_queries) AS n_queries FROM tp, me GROUP BY 1"""


@CAT.query("met_trimodal", _TRI)
def _met_trimodal(spark, d):
    """NDCG and recall of the combined run of three modalities, and how many hits are of which match type."""
    hits = trimodal(spark, d)
    top = ranked(hits, ["query_id"], by_score(), 100)
    q = rel(spark, d, "qrels").where("relevance > 0").groupBy(F.split_part("query_id", F.lit("-"), F.lit(1)).alias("query_id"), "doc_id").agg(F.max("relevance").alias("relevance"))
    per = per_query(top.withColumn("system", F.lit("trimodal")).select("system", "query_id", "doc_id", "score"), q, [10, 100], universe="intersect")
    kinds = top.groupBy("match_type").agg(F.count(F.lit(1)).alias("n_hits"))
    m = per.agg(F.round(F.avg("ndcg_10"), 6).alias("ndcg_10"), F.round(F.avg("r_100"), 6).alias("recall_100"), F.count(F.lit(1)).alias("n_queries"))  # one row
    return kinds.crossJoin(F.broadcast(m))


@CAT.query("an_agreement_grades", "WITH a AS (SELECT clean_id(statement_id) AS query_id, clean_id(doc_id) AS doc_id, min(agreement) AS agreement FROM consensus_labels WHERE agreement IS NOT NULL AND statement_id IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1, 2), " + withs("qrels")[5:] + " SELECT agreement, relevance, count(*) AS n FROM qrels JOIN a USING (query_id, doc_id) GROUP BY 1, 2")
def _agreement_grades(spark, d):
    return rel(spark, d, "qrels").join(agreed(spark, d), ["query_id", "doc_id"]).groupBy("agreement", "relevance").agg(F.count(F.lit(1)).alias("n"))


def table_lines(df: DataFrame, name: str, metrics: list[str], digits: int = 4) -> DataFrame:
    """(position, line) of a small result as a Markdown table: the best value of each column in bold,
    rows in order of their names. A row per system reaches the window."""
    best = df.agg(*(F.max(F.round(m, digits)).alias(f"_{m}") for m in metrics))  # one row
    text = lambda m: F.format_string(f"%.{digits}f", F.round(m, digits))
    cell = lambda m: F.when(F.round(m, digits) == F.col(f"_{m}"), F.concat(F.lit("**"), text(m), F.lit("**"))).otherwise(text(m))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", name, *(cell(m) for m in metrics)), F.lit(" |"))
    rows = df.crossJoin(F.broadcast(best)).select((F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(name)) + 1).alias("position"), line.alias("line"))
    head = [(0, "| " + " | ".join([name, *metrics]) + " |"), (1, "|" + " --- |" * (len(metrics) + 1))]  # no row of data
    return df.sparkSession.createDataFrame(head, "position int, line string").unionByName(rows)


@CAT.query("rpt_format", _sql([10]) + ", m AS (SELECT system, round(avg(r_10), 4) AS r, round(avg(ndcg_10), 4) AS n FROM per GROUP BY 1), t AS (SELECT *, max(r) OVER () AS br, max(n) OVER () AS bn FROM m) SELECT 0 AS position, '| system | r_10 | ndcg_10 |' AS line UNION ALL SELECT 1, '| --- | --- | --- |' UNION ALL SELECT (row_number() OVER (ORDER BY system) + 1)::INT, '| ' || system || ' | ' || CASE WHEN r = br THEN printf('**%.4f**', r) ELSE printf('%.4f', r) END || ' | ' || CASE WHEN n = bn THEN printf('**%.4f**', n) ELSE printf('%.4f', n) END || ' |' FROM t")
def _report(spark, d):
    """Means per system as a table for a report."""
    m = _per(spark, d).groupBy("system").agg(F.avg("r_10").alias("r_10"), F.avg("ndcg_10").alias("ndcg_10"))
    return table_lines(m, "system", ["r_10", "ndcg_10"])
