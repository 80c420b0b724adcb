"""Significance, correlation and agreement, and the analyses built on them."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_id
from ..plans.catalog import Catalogue, rel, withs
from ..sources.tables import table
from .metrics import _sql, per_query

CAT = Catalogue()
queries, oracle_sql = CAT.queries, CAT.oracle_sql


def pearson(x: str, y: str) -> Column:
    """Correlation as an aggregate; 0 where either side is constant."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def kappa(df: DataFrame, a: str, b: str, by: list[str], weighted: bool = False, grades: int = 4) -> DataFrame:
    """(by..., n, observed, kappa) of two integer labels per row, from the contingency table
    alone; quadratic weights if asked. 0 where chance agreement is complete."""
    cells = df.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("n"))
    w = F.pow((F.col(a) - F.col(b)) / F.lit(float(grades - 1)), 2) if weighted else F.when(F.col(a) == F.col(b), 0.0).otherwise(1.0)
    total = cells.groupBy(*by).agg(F.sum("n").alias("t"), F.sum(F.col("n") * w).alias("wo"))
    ra = cells.groupBy(*by, F.col(a).alias("i")).agg(F.sum("n").alias("na"))
    rb = cells.groupBy(*by, F.col(b).alias("j")).agg(F.sum("n").alias("nb"))
    we = F.pow((F.col("i") - F.col("j")) / F.lit(float(grades - 1)), 2) if weighted else F.when(F.col("i") == F.col("j"), 0.0).otherwise(1.0)
    exp = ra.join(rb, by).groupBy(*by).agg(F.sum(F.col("na").cast("double") * F.col("nb") * we).alias("we"))  # at most grades x grades rows per group
    j = total.join(exp, by)
    o, e = F.col("wo") / F.col("t"), F.col("we") / (F.col("t") * F.col("t"))
    return j.select(*by, F.col("t").alias("n"), F.round(1 - o, 6).alias("observed"), F.round(F.coalesce(1 - F.try_divide(o, e), F.lit(0.0)), 6).alias("kappa"))


_PAIR = withs("judged", "qrels") + ", p AS (SELECT j.model, j.score AS a, q.relevance AS b FROM judged j JOIN qrels q USING (query_id, doc_id))"


def _pairs(spark, d) -> DataFrame:
    return rel(spark, d, "judged").join(rel(spark, d, "qrels"), ["query_id", "doc_id"]).select("model", "query_id", "doc_id", F.col("score").alias("a"), F.col("relevance").alias("b"))


@CAT.query("st_cohen", _PAIR + """, c AS (SELECT model, a, b, count(*)::DOUBLE AS n FROM p GROUP BY 1, 2, 3), t AS (SELECT model, sum(n) AS t, sum(CASE WHEN a = b THEN 0 ELSE n END) AS wo FROM c GROUP BY 1), x AS (SELECT model, a, sum(n) AS na FROM c GROUP BY 1, 2), y AS (SELECT model, b, sum(n) AS nb FROM c GROUP BY 1, 2),
e AS (SELECT model, sum(CASE WHEN a = b THEN 0 ELSE na * nb END) AS we FROM x JOIN y USING (model) GROUP BY 1) SELECT model, t::BIGINT AS n, round(1 - wo / t, 6) AS observed, round(coalesce(1 - (wo / t) / nullif(we / (t * t), 0), 0), 6) AS kappa FROM t JOIN e USING (model)""")
def _cohen(spark, d):
    return kappa(_pairs(spark, d), "a", "b", ["model"])


@CAT.query("st_cohen_w", _PAIR + """, c AS (SELECT model, a, b, count(*)::DOUBLE AS n FROM p GROUP BY 1, 2, 3), t AS (SELECT model, sum(n) AS t, sum(n * ((a - b) / 3.0::DOUBLE) ** 2) AS wo FROM c GROUP BY 1), x AS (SELECT model, a, sum(n) AS na FROM c GROUP BY 1, 2), y AS (SELECT model, b, sum(n) AS nb FROM c GROUP BY 1, 2),
e AS (SELECT model, sum(na * nb * ((a - b) / 3.0::DOUBLE) ** 2) AS we FROM x JOIN y USING (model) GROUP BY 1) SELECT model, t::BIGINT AS n, round(1 - wo / t, 6) AS observed, round(coalesce(1 - (wo / t) / nullif(we / (t * t), 0), 0), 6) AS kappa FROM t JOIN e USING (model)""")
def _cohen_w(spark, d):
    return kappa(_pairs(spark, d), "a", "b", ["model"], weighted=True)


@CAT.query("st_fleiss", withs("judged") + """, v AS (SELECT query_id, doc_id, score, count(*) AS n FROM judged GROUP BY 1, 2, 3), i AS (SELECT query_id, doc_id, sum(n * n) AS sq FROM v GROUP BY 1, 2 HAVING sum(n) = 3), o AS (SELECT count(*) AS n_items, avg((sq - 3)::DOUBLE / 6) AS po FROM i),
g AS (SELECT score, sum(v.n)::DOUBLE AS m FROM v SEMI JOIN i USING (query_id, doc_id) GROUP BY 1), e AS (SELECT sum((m / (SELECT sum(m) FROM g)) ** 2) AS pe FROM g) SELECT n_items, round(po, 6) AS observed, round(CASE WHEN abs(1 - pe) < 1e-10 THEN 1 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM o, e""")
def _fleiss(spark, d):
    return fleiss(rel(spark, d, "judged"), ["query_id", "doc_id"], "score", range(4), 3)


def fleiss(df: DataFrame, item: list[str], grade: str, grades, raters: int) -> DataFrame:
    """(n_items, observed, kappa) over the items with exactly as many ratings as there are raters; others
    are incomplete and left out. 1 where chance agreement is complete."""
    v = df.groupBy(*item).agg(*(F.count_if(F.col(grade) == k).alias(f"n{k}") for k in grades), F.count(F.lit(1)).alias("n")).where(F.col("n") == raters)
    pairs = sum(F.col(f"n{k}") * (F.col(f"n{k}") - 1) for k in grades)
    t = v.agg(F.count(F.lit(1)).alias("n_items"), F.avg(pairs / F.lit(float(raters * (raters - 1)))).alias("po"), F.sum("n").alias("n"), *(F.sum(f"n{k}").alias(f"n{k}") for k in grades))
    pe = sum(F.pow(F.try_divide(F.col(f"n{k}"), F.col("n")), 2) for k in grades)
    return t.select("n_items", F.round("po", 6).alias("observed"), F.round(F.when(F.abs(1 - pe) < 1e-10, 1.0).otherwise((F.col("po") - pe) / (1 - pe)), 6).alias("kappa"))


@CAT.query("st_majority", withs("judged") + """, v AS (SELECT query_id, doc_id, score, count(*) AS n FROM judged GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY n DESC, score) AS k, count(*) OVER (PARTITION BY query_id, doc_id) AS kinds FROM v), m AS (SELECT query_id, doc_id, list_sort(list(score)) AS s FROM judged GROUP BY 1, 2)
SELECT query_id, doc_id, CASE WHEN kinds = 1 THEN 'unanimous' WHEN n >= 2 THEN 'majority' ELSE 'no_consensus' END AS agreement, (CASE WHEN kinds = 1 OR n >= 2 THEN score ELSE s[len(s) // 2 + 1] END)::INT AS label FROM r JOIN m USING (query_id, doc_id) WHERE k = 1""")
def _majority(spark, d):
    # counts per grade in one aggregation: an item's votes are four numbers, not a list
    v = rel(spark, d, "judged").groupBy("query_id", "doc_id").agg(*(F.count_if(F.col("score") == k).alias(f"n{k}") for k in range(4)), F.count(F.lit(1)).alias("n"))
    best = F.array_min(F.array(*(F.struct((-F.col(f"n{k}")).alias("o"), F.lit(k).alias("g")) for k in range(4))))
    mid = F.floor(F.col("n") / 2) + 1
    run, median = F.lit(0), None
    for k in range(4):
        run = run + F.col(f"n{k}")
        median = F.when(run >= mid, k) if median is None else median.when(run >= mid, k)
    v = v.withColumn("b", best).withColumn("most", -F.col("b.o"))
    kind = F.when(F.col("most") == F.col("n"), "unanimous").when(F.col("most") >= 2, "majority").otherwise("no_consensus")
    return v.select("query_id", "doc_id", kind.alias("agreement"), F.when(kind == "no_consensus", median).otherwise(F.col("b.g")).alias("label"))


@CAT.query("st_macro_f1", _PAIR + """, k AS (SELECT model, unnest([0, 1, 2, 3]) AS c FROM (SELECT DISTINCT model FROM p)), f AS (SELECT k.model, c, count(*) FILTER (WHERE a = c AND b = c) AS tp, count(*) FILTER (WHERE a = c AND b <> c) AS fp, count(*) FILTER (WHERE a <> c AND b = c) AS fn FROM k JOIN p USING (model) GROUP BY 1, 2)
SELECT f.model, round(any_value(acc), 6) AS accuracy, round(avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END), 6) AS macro_f1 FROM f JOIN (SELECT model, avg((a = b)::INT) AS acc FROM p GROUP BY 1) USING (model) GROUP BY 1""")
def _f1(spark, d):
    p = _pairs(spark, d)
    t = p.groupBy("model").agg(F.avg((F.col("a") == F.col("b")).cast("int")).alias("acc"), *(x for k in range(4) for x in (F.count_if((F.col("a") == k) & (F.col("b") == k)).alias(f"tp{k}"), F.count_if((F.col("a") == k) != (F.col("b") == k)).alias(f"e{k}"))))
    f = [F.coalesce(F.try_divide(2.0 * F.col(f"tp{k}"), 2.0 * F.col(f"tp{k}") + F.col(f"e{k}")), F.lit(0.0)) for k in range(4)]
    return t.select("model", F.round("acc", 6).alias("accuracy"), F.round((f[0] + f[1] + f[2] + f[3]) / 4, 6).alias("macro_f1"))


@CAT.query("st_confusion", _PAIR + " SELECT model, b AS gold, count(*) FILTER (WHERE a = 0) AS p0, count(*) FILTER (WHERE a = 1) AS p1, count(*) FILTER (WHERE a = 2) AS p2, count(*) FILTER (WHERE a = 3) AS p3 FROM p GROUP BY 1, 2")
def _confusion(spark, d):
    return _pairs(spark, d).groupBy("model", F.col("b").alias("gold")).agg(*(F.count_if(F.col("a") == k).alias(f"p{k}") for k in range(4)))


@CAT.query("st_kl", _PAIR + ", g AS (SELECT unnest([0, 1, 2, 3]) AS c), x AS (SELECT model, c, avg((a = c)::INT) + 1e-10::DOUBLE AS u, avg((b = c)::INT) + 1e-10::DOUBLE AS v FROM p, g GROUP BY 1, 2) SELECT model, round(sum(u * ln(u / v)), 6) AS divergence FROM x GROUP BY 1")
def _kl(spark, d):
    t = _pairs(spark, d).groupBy("model").agg(*(x for k in range(4) for x in (F.avg((F.col("a") == k).cast("int")).alias(f"u{k}"), F.avg((F.col("b") == k).cast("int")).alias(f"v{k}"))))
    part = [(F.col(f"u{k}") + 1e-10) * F.log((F.col(f"u{k}") + 1e-10) / (F.col(f"v{k}") + 1e-10)) for k in range(4)]
    return t.select("model", F.round(part[0] + part[1] + part[2] + part[3], 6).alias("divergence"))


@CAT.query("st_pearson", withs("judged") + ", m AS (SELECT a.model AS model_a, b.model AS model_b, a.score::DOUBLE AS x, b.score::DOUBLE AS y FROM judged a JOIN judged b USING (query_id, doc_id) WHERE a.model < b.model) SELECT model_a, model_b, count(*) AS n, round(coalesce(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 0), 6) AS r FROM m GROUP BY 1, 2")
def _pearson(spark, d):
    return _model_pairs(spark, d).groupBy("model_a", "model_b").agg(F.count(F.lit(1)).alias("n"), F.round(pearson("x", "y"), 6).alias("r"))


def _model_pairs(spark, d) -> DataFrame:
    """Scores of two models for the same item. An item has at most one score per model."""
    j = rel(spark, d, "judged")
    a = j.select("query_id", "doc_id", F.col("model").alias("model_a"), F.col("score").alias("x"))
    b = j.select("query_id", "doc_id", F.col("model").alias("model_b"), F.col("score").alias("y"))
    return a.join(b, ["query_id", "doc_id"]).where("model_a < model_b")


@CAT.query("st_spearman", withs("judged") + ", m AS (SELECT a.model AS model_a, b.model AS model_b, query_id, doc_id, a.score AS x, b.score AS y FROM judged a JOIN judged b USING (query_id, doc_id) WHERE a.model < b.model), r AS (SELECT model_a, model_b, rank() OVER (PARTITION BY model_a, model_b ORDER BY x) + (count(*) OVER (PARTITION BY model_a, model_b, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY model_a, model_b ORDER BY y) + (count(*) OVER (PARTITION BY model_a, model_b, y) - 1) / 2.0::DOUBLE AS ry FROM m) SELECT model_a, model_b, round(coalesce(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 0), 6) AS rho FROM r GROUP BY 1, 2")
def _spearman(spark, d):
    # grades are few: ranks come from the contingency table, not from sorting the items
    cells = _model_pairs(spark, d).groupBy("model_a", "model_b", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))

    def mid(v: str) -> DataFrame:
        t = cells.groupBy("model_a", "model_b", v).agg(F.sum("n").alias("m"))
        upto = F.sum("m").over(Window.partitionBy("model_a", "model_b").orderBy(v))
        return t.select("model_a", "model_b", v, (upto - F.col("m") + (F.col("m") + 1) / 2).alias(f"r{v}"))

    c = cells.join(mid("x"), ["model_a", "model_b", "x"]).join(mid("y"), ["model_a", "model_b", "y"])
    s = lambda e: F.sum(F.col("n") * e)
    t = c.groupBy("model_a", "model_b").agg(F.sum("n").alias("n"), s(F.col("rx")).alias("sx"), s(F.col("ry")).alias("sy"), s(F.col("rx") * F.col("ry")).alias("sxy"), s(F.col("rx") * F.col("rx")).alias("sxx"), s(F.col("ry") * F.col("ry")).alias("syy"))
    cov = F.col("sxy") / F.col("n") - F.col("sx") / F.col("n") * F.col("sy") / F.col("n")
    var = lambda a, b: F.col(a) / F.col("n") - F.pow(F.col(b) / F.col("n"), 2)
    return t.select("model_a", "model_b", F.round(F.coalesce(F.try_divide(cov, F.sqrt(F.greatest(var("sxx", "sx"), F.lit(0.0))) * F.sqrt(F.greatest(var("syy", "sy"), F.lit(0.0)))), F.lit(0.0)), 6).alias("rho"))


_DIFF = _sql([10]) + ", d AS (SELECT a.system AS system_a, b.system AS system_b, a.ndcg_10 - b.ndcg_10 AS x FROM per a JOIN per b USING (query_id) WHERE a.system < b.system)"


def differences(per: DataFrame, metric: str) -> DataFrame:
    a = per.select("query_id", F.col("system").alias("system_a"), F.col(metric).alias("_a"))
    b = per.select("query_id", F.col("system").alias("system_b"), F.col(metric).alias("_b"))
    return a.join(b, "query_id").where("system_a < system_b").select("system_a", "system_b", "query_id", (F.col("_a") - F.col("_b")).alias("x"))


@CAT.query("st_ttest", _DIFF + " SELECT system_a, system_b, count(*) AS n, round(avg(x), 6) AS mean, round(coalesce(avg(x) / nullif(stddev_samp(x) / sqrt(count(*)), 0), 0), 5) AS t FROM d GROUP BY 1, 2")
def _ttest(spark, d):
    x = differences(per_query(rel(spark, d, "scored"), rel(spark, d, "qrels"), [10]), "ndcg_10")
    t = F.coalesce(F.try_divide(F.avg("x"), F.stddev_samp("x") / F.sqrt(F.count(F.lit(1)))), F.lit(0.0))
    return x.groupBy("system_a", "system_b").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(t, 5).alias("t"))


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    from math import exp, lgamma, log

    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    tiny, f, c, dd = 1e-30, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        n = 1.0 if i == 0 else (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        dd = 1 / (1 + n * dd if abs(1 + n * dd) > tiny else tiny)
        c = 1 + n / c if abs(1 + n / c) > tiny else tiny
        f *= c * dd
        if abs(1 - c * dd) < 1e-13:
            break
    return front * (f - 1)


def t_p_value(t: float, n: int) -> float:
    """Two-sided p-value of Student's t with n - 1 degrees of freedom."""
    if n < 2 or t != t:
        return 1.0
    v = n - 1
    return _incomplete_beta(v / 2, 0.5, v / (v + t * t))


def _tested(spark, d) -> DataFrame:
    """(system_a, system_b, n, mean, t, p) of the paired t-test on NDCG."""

    @F.pandas_udf("double")
    def p_value(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([t_p_value(a, int(b)) for a, b in zip(t, n)], dtype=float)

    x = differences(per_query(rel(spark, d, "scored"), rel(spark, d, "qrels"), [10]), "ndcg_10")
    t = F.coalesce(F.try_divide(F.avg("x"), F.stddev_samp("x") / F.sqrt(F.count(F.lit(1)))), F.lit(0.0))
    return x.groupBy("system_a", "system_b").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), t.alias("t")).withColumn("p", p_value("t", "n"))


#: The two-sided p-value of Student's t for whole degrees of freedom as a finite series.
_P_VALUE = """, t AS (SELECT system_a, system_b, count(*) AS n, avg(x) AS mean, coalesce(avg(x) / nullif(stddev_samp(x) / sqrt(count(*)), 0), 0) AS t FROM d GROUP BY 1, 2),
k AS (SELECT *, n - 1 AS v, atan(abs(t) / sqrt(n - 1)) AS th FROM t WHERE n >= 2), z AS (SELECT system_a, system_b, CASE WHEN v % 2 = 1
  THEN 2 / pi() * (any_value(th) + sum(CASE WHEN 2 * j + 3 <= v THEN sin(th) * cos(th) ** (2 * j + 1) * sqrt(pi()) * exp(lgamma(j + 1) - lgamma(j + 1.5)) / 2 ELSE 0 END))
  ELSE sum(CASE WHEN 2 * j + 2 <= v THEN sin(th) * cos(th) ** (2 * j) * exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) ELSE 0 END) END AS a
  FROM k, range(0, (SELECT coalesce(max(n), 0) FROM t)) r(j) GROUP BY system_a, system_b, v), h AS (SELECT t.*, CASE WHEN n < 2 THEN 1 ELSE greatest(0, 1 - a) END AS p FROM t LEFT JOIN z USING (system_a, system_b))"""


@CAT.query("st_sig_matrix", _DIFF + _P_VALUE + ", m AS (SELECT *, round(least(p * count(*) OVER (), 1), 6) AS p_corrected FROM h) SELECT system_a, system_b, n, round(mean, 6) AS mean, round(t, 5) AS t, round(p, 6) AS p, p_corrected FROM m UNION ALL SELECT system_b, system_a, n, -round(mean, 6), -round(t, 5), round(p, 6), p_corrected FROM m")
def _matrix(spark, d):
    """All pairs of systems, mirrored, with t, two-sided p and Bonferroni's correction."""

    half = _tested(spark, d).select("system_a", "system_b", "n", F.round("mean", 6).alias("mean"), F.round("t", 5).alias("t"), "p")
    both = half.unionByName(half.select(F.col("system_b").alias("system_a"), F.col("system_a").alias("system_b"), "n", (-F.col("mean")).alias("mean"), (-F.col("t")).alias("t"), "p"))
    pairs = half.agg(F.count(F.lit(1)).alias("m"))
    return both.crossJoin(F.broadcast(pairs)).select("system_a", "system_b", "n", "mean", "t", F.round("p", 6).alias("p"), F.round(F.least(F.col("p") * F.col("m"), F.lit(1.0)), 6).alias("p_corrected"))


@CAT.query("st_bonferroni", _DIFF + _P_VALUE + " SELECT system_a, system_b, round(p, 6) AS p, round(least(p * count(*) OVER (), 1.0), 6) AS corrected FROM h")
def _bonferroni(spark, d):
    """p-values of the paired t-tests, times their number, at most 1."""
    t = _tested(spark, d)
    return t.crossJoin(F.broadcast(t.agg(F.count(F.lit(1)).alias("m")))).select("system_a", "system_b", F.round("p", 6).alias("p"), F.round(F.least(F.col("p") * F.col("m"), F.lit(1.0)), 6).alias("corrected"))


def bootstrap(values: np.ndarray, draws: int = 10_000, confidence: float = 0.95, seed: int = 42) -> tuple[float, float, float]:
    """Mean and percentile interval of the mean; values in a fixed order, legacy generator."""
    if not len(values):
        return 0.0, 0.0, 0.0
    rng = np.random.RandomState(seed)
    means = np.array([values[rng.randint(0, len(values), len(values))].mean() for _ in range(draws)])
    lo, hi = np.percentile(means, [(1 - confidence) / 2 * 100, (1 + confidence) / 2 * 100])
    return float(values.mean()), float(lo), float(hi)


def _booted(by: list[str], value: str):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        m, lo, hi = bootstrap(p.sort_values("query_id")[value].to_numpy())
        return pd.DataFrame({**{b: [p[b].iloc[0]] for b in by}, "mean": [m], "lower": [lo], "upper": [hi], "significant": [bool(lo > 0 or hi < 0)]})

    return run


@CAT.query("st_boot_ci")
def _boot(spark, d):
    """Interval of mean NDCG per system; a group holds one number per query."""
    per = per_query(rel(spark, d, "scored"), rel(spark, d, "qrels"), [10]).select("system", "query_id", "ndcg_10")
    return per.groupBy("system").applyInPandas(_booted(["system"], "ndcg_10"), "system string, mean double, lower double, upper double, significant boolean")


@CAT.query("st_boot_paired")
def _boot_paired(spark, d):
    """Interval of the mean difference per pair of systems; significant if it excludes 0."""
    x = differences(per_query(rel(spark, d, "scored"), rel(spark, d, "qrels"), [10]), "ndcg_10")
    return x.groupBy("system_a", "system_b").applyInPandas(_booted(["system_a", "system_b"], "x"), "system_a string, system_b string, mean double, lower double, upper double, significant boolean")


@CAT.query("an_grade_dist", withs("judged") + "SELECT model, score, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY model), 6) AS share FROM judged GROUP BY 1, 2")
def _grades(spark, d):
    g = rel(spark, d, "judged").groupBy("model", "score").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("model")), 6))


@CAT.query("an_difficulty", _sql([10]) + ", m AS (SELECT query_id, avg(r_10) AS r FROM per GROUP BY 1), b AS (SELECT query_id, CASE WHEN r < 0.3 THEN 'hard' WHEN r <= 0.7 THEN 'medium' ELSE 'easy' END AS bucket FROM m) SELECT system, bucket, count(*) AS n, round(avg(ndcg_10), 6) AS ndcg_10 FROM per JOIN b USING (query_id) GROUP BY 1, 2")
def _difficulty(spark, d):
    # the mean over systems is a window over rows already partitioned by query
    per = per_query(rel(spark, d, "scored"), rel(spark, d, "qrels"), [10])
    r = F.avg("r_10").over(Window.partitionBy("query_id"))
    b = F.when(F.col("_r") < 0.3, "hard").when(F.col("_r") <= 0.7, "medium").otherwise("easy")
    return per.withColumn("_r", r).groupBy("system", b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ndcg_10"), 6).alias("ndcg_10"))


@CAT.query("an_error", withs("judged", "qrels", "q_domain") + "SELECT model, domain, relevance, count(*) AS n, round(avg((score = relevance)::INT), 6) AS accuracy FROM judged JOIN qrels USING (query_id, doc_id) JOIN q_domain USING (query_id) GROUP BY GROUPING SETS ((model, domain), (model, relevance), (model))")
def _error(spark, d):
    p = rel(spark, d, "judged").join(rel(spark, d, "qrels"), ["query_id", "doc_id"]).join(rel(spark, d, "q_domain"), "query_id").select("model", "domain", "relevance", (F.col("score") == F.col("relevance")).cast("int").alias("ok"))
    sets = p.groupingSets([["model", "domain"], ["model", "relevance"], ["model"]], "model", "domain", "relevance")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ok"), 6).alias("accuracy"))


@CAT.query("an_summary", _sql([10]) + ", m AS (SELECT system, avg(ndcg_10) AS v FROM per GROUP BY 1) SELECT system AS best, round(v, 6) AS ndcg_10 FROM m ORDER BY round(v, 9) DESC, system LIMIT 1")
def _summary(spark, d):
    m = per_query(rel(spark, d, "scored"), rel(spark, d, "qrels"), [10]).groupBy("system").agg(F.avg("ndcg_10").alias("v"))
    return m.agg(F.min(F.struct((-F.round("v", 9)).alias("o"), "system", "v")).alias("m")).select(F.col("m.system").alias("best"), F.round("m.v", 6).alias("ndcg_10"))


@CAT.query("an_gt_strat", _PAIR.replace("j.score AS a", "query_id, doc_id, j.score AS a") + ", g AS (SELECT clean_id(statement_id) AS query_id, clean_id(doc_id) AS doc_id, min(agreement) AS agreement FROM consensus_labels WHERE agreement IS NOT NULL GROUP BY 1, 2) SELECT agreement, count(*) AS n, round(avg((a = b)::INT), 6) AS accuracy FROM p JOIN g USING (query_id, doc_id) GROUP BY 1")
def _strat(spark, d):
    g = table(spark, d, "consensus_labels").where("agreement is not null").groupBy(clean_id("statement_id").alias("query_id"), clean_id("doc_id").alias("doc_id")).agg(F.min("agreement").alias("agreement"))
    return _pairs(spark, d).join(g, ["query_id", "doc_id"]).groupBy("agreement").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("a") == F.col("b")).cast("int")), 6).alias("accuracy"))
