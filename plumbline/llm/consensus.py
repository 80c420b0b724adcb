"""Consensus of several annotators by expectation-maximisation.

Every annotator has a confusion matrix P(label given | true grade), every item
a posterior over the grades. Both are estimated together with Dirichlet
smoothing that leans to the diagonal. Votes are weighted: an annotator has one
vote per item, divided among the labels it gave there if it judged repeatedly.

Scale: votes are pre-aggregated to (item, annotator, label), so an item with a
third of all rows becomes at most four entries per annotator; items are then
pre-aggregated to distinct patterns of votes, over which the iterations run.
A task reduces its patterns to one row per (annotator, label); the driver
holds the model alone, 16 numbers per annotator (at most ``MAX_ANNOTATORS``).

The chance-corrected agreement (Fleiss' kappa) is reported separately and
doesn't depend on the model.

Defined cases: labels that are null or outside the grades are no votes; a vote
without annotator counts for the annotator ``(unknown)``; items without any
vote take the consensus already stored, if valid, else the most frequent
grade; of equally probable grades the lower one is taken; ids are compared in
clean form, null ids give no item; empty tables give no rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_id
from ..plans.shared import discard, materialize
from ..sources.tables import table

GRADES = 4
MAX_ANNOTATORS = 200_000
#: Pseudo-votes per confusion row: on the diagonal, and on each other label.
SMOOTH_DIAGONAL, SMOOTH_OTHER = 2.0, 0.5
MAX_ROUNDS, TOLERANCE = 60, 1e-4


def posteriors(codes: pa.ListArray, weights: pa.ListArray, logs: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Grade posteriors (rows x grades) of vote patterns. logs: (codes x grades)."""
    offsets = codes.offsets.to_numpy()
    c, w = codes.values.to_numpy(zero_copy_only=False), weights.values.to_numpy(zero_copy_only=False)
    total = np.zeros((len(codes), GRADES))
    row = np.repeat(np.arange(len(codes)), np.diff(offsets))
    part = logs[c[offsets[0] : offsets[-1]]] * w[offsets[0] : offsets[-1], None]
    for k in range(GRADES):
        total[:, k] = np.bincount(row, weights=part[:, k], minlength=len(codes))
    total += np.log(prior)
    total -= total.max(axis=1, keepdims=True)
    p = np.exp(total)
    return p / p.sum(axis=1, keepdims=True)


def _expected(model, n_codes: int):
    """E-step of one task: expected votes per code and grade, and per grade at code -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, grades = np.zeros((n_codes, GRADES)), np.zeros(GRADES)
        for b in batches:
            if not b.num_rows:
                continue
            codes, weights, n = b.column(0), b.column(1), b.column(2).to_numpy(zero_copy_only=False)
            if model is None:  # the start: shares of votes
                offsets = codes.offsets.to_numpy()
                row = np.repeat(np.arange(len(codes)), np.diff(offsets))
                c, w = codes.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], weights.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
                p = np.full((len(codes), GRADES), 0.05)
                np.add.at(p, (row, c % GRADES), w)
                p /= p.sum(axis=1, keepdims=True)
            else:
                p = posteriors(codes, weights, *model)
            p = p * n[:, None]
            offsets = codes.offsets.to_numpy()
            row = np.repeat(np.arange(len(codes)), np.diff(offsets))
            c, w = codes.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], weights.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            for k in range(GRADES):
                sums[:, k] += np.bincount(c, weights=p[row, k] * w, minlength=n_codes)
            grades += p.sum(axis=0)
        used = np.flatnonzero(sums.sum(axis=1) > 0)
        out = np.vstack([sums[used], grades[None, :]])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int64()), *(pa.array(out[:, k]) for k in range(GRADES))], names=["code", *(f"g{k}" for k in range(GRADES))])

    return run


def fit(patterns: DataFrame, n_annotators: int, labels: dict[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Confusion matrices (annotators x grades x labels) and prior, from patterns
    (codes array<int>, weights array<double>, n bigint); code = annotator * 4 + label.
    ``labels``: annotators with another number of labels than grades (a yes/no annotator)."""
    n_codes = n_annotators * GRADES
    schema = "code bigint, " + ", ".join(f"g{k} double" for k in range(GRADES))
    model, conf, prior, last = None, None, None, None
    base = np.full((GRADES, GRADES), SMOOTH_OTHER)
    np.fill_diagonal(base, SMOOTH_DIAGONAL)
    for _ in range(MAX_ROUNDS):
        rows = patterns.mapInArrow(_expected(model, n_codes), schema).groupBy("code").agg(*(F.sum(f"g{k}").alias(f"g{k}") for k in range(GRADES))).collect()
        votes, grades = np.zeros((n_codes, GRADES)), np.ones(GRADES)
        for r in rows:
            if r[0] < 0:
                grades = grades + np.array(r[1:])
            else:
                votes[r[0]] = r[1:]
        conf = votes.reshape(n_annotators, GRADES, GRADES).transpose(0, 2, 1) + base
        for a, n in (labels or {}).items():
            conf[a] = votes.reshape(n_annotators, GRADES, GRADES)[a].T + 1.0
            conf[a][:, n:] = 1e-9
        conf /= conf.sum(axis=2, keepdims=True)
        prior = grades / grades.sum()
        model = (np.log(conf.transpose(0, 2, 1).reshape(n_codes, GRADES)), prior)
        if last is not None and np.abs(conf - last).max() < TOLERANCE:
            break
        last = conf
    else:
        warnings.warn(f"confusion matrices not settled within {TOLERANCE} after {MAX_ROUNDS} rounds", stacklevel=2)
    return conf, prior


def _valid(c: Column) -> Column:
    return (c >= 0) & (c < GRADES)


def raw_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(statement_id, doc_id, annotator, label, n): votes of both tables, repeated deliveries once."""
    j = table(spark, sf_dir, "relevance_judgments").select("judgment_id", clean_id("statement_id").alias("statement_id"), clean_id("doc_id").alias("doc_id"), "model", F.col("relevance_score").alias("label")).distinct()
    c = _labels(spark, sf_dir).select("label_id", "statement_id", "doc_id", F.explode("individual_scores").alias("model", "label")).distinct()
    both = j.drop("judgment_id").unionByName(c.drop("label_id")).where("statement_id is not null and doc_id is not null").where(_valid(F.col("label")))
    return both.groupBy("statement_id", "doc_id", F.coalesce("model", F.lit("(unknown)")).alias("annotator"), "label").agg(F.count(F.lit(1)).alias("n"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "consensus_labels").select("label_id", clean_id("statement_id").alias("statement_id"), clean_id("doc_id").alias("doc_id"), "consensus_score", "individual_scores", "examiner_agrees")


EXAMINER, STORED = "(examiner)", "(stored)"


def _items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """(statement_id, doc_id, codes, weights, stored) of every item, and the annotators in the order of their codes.

    Two further annotators are taken from the stored consensus: the examiner,
    whose agreement tells whether the item is relevant at all, and the stored
    consensus itself where the single scores behind it are lost."""
    labels = _labels(spark, sf_dir).where("statement_id is not null and doc_id is not null")
    seen = labels.select("statement_id", "doc_id").unionByName(table(spark, sf_dir, "relevance_judgments").select(clean_id("statement_id").alias("statement_id"), clean_id("doc_id").alias("doc_id")).where("statement_id is not null and doc_id is not null"))
    ok = _valid(F.col("consensus_score"))
    relevant = (F.col("consensus_score") > 0) == F.col("examiner_agrees")
    extra = labels.where(ok & F.col("examiner_agrees").isNotNull()).select("statement_id", "doc_id", F.lit(EXAMINER).alias("annotator"), relevant.cast("int").alias("label"))
    extra = extra.unionByName(labels.where(ok & F.col("individual_scores").isNull()).select("statement_id", "doc_id", F.lit(STORED).alias("annotator"), F.col("consensus_score").alias("label")))
    extra = extra.groupBy("statement_id", "doc_id", "annotator", "label").agg(F.count(F.lit(1)).alias("n"))
    votes = materialize(raw_votes(spark, sf_dir).unionByName(extra), "votes")
    names = [r[0] for r in votes.select("annotator").distinct().orderBy("annotator").limit(MAX_ANNOTATORS + 1).collect()]
    if len(names) > MAX_ANNOTATORS:
        raise ValueError(f"more than {MAX_ANNOTATORS} annotators")
    code = spark.createDataFrame([(a, i) for i, a in enumerate(names)], "annotator string, idx int")
    per = votes.groupBy("statement_id", "doc_id", "annotator").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("given"), F.sum("n").alias("total"))
    share = F.when(F.col("annotator") == STORED, 0.5).otherwise(1.0)
    each = per.join(code, "annotator").select("statement_id", "doc_id", "idx", share.alias("share"), "total", F.explode("given").alias("label", "n"))
    entry = F.struct((F.col("idx") * GRADES + F.col("label")).cast("int").alias("c"), (F.col("share") * F.col("n") / F.col("total")).alias("w"))
    lists = each.groupBy("statement_id", "doc_id").agg(F.array_sort(F.collect_list(entry)).alias("v"))
    stored = labels.where(ok).groupBy("statement_id", "doc_id").agg(F.min("consensus_score").alias("stored"))
    items = seen.distinct().join(lists, ["statement_id", "doc_id"], "left").join(stored, ["statement_id", "doc_id"], "left")
    empty_i, empty_d = F.array().cast("array<int>"), F.array().cast("array<double>")
    items = items.select("statement_id", "doc_id", F.coalesce(F.col("v.c"), empty_i).alias("codes"), F.coalesce(F.col("v.w"), empty_d).alias("weights"), "stored")
    return materialize(items, "items"), names


def model(items: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    patterns = materialize(items.where(F.size("codes") > 0).groupBy("codes", "weights").agg(F.count(F.lit(1)).alias("n")), "patterns")
    special = {i: 2 for i, a in enumerate(names) if a == EXAMINER}
    fitted = fit(patterns, max(1, len(names)), special)
    discard(patterns)
    return fitted


def _graded(logs: np.ndarray, prior: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = posteriors(b.column(2), b.column(3), logs, prior)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(4), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(p.max(axis=1)), b.column(5)], names=["statement_id", "doc_id", "stored", "grade", "confidence", "n_votes"])

    return run


def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(statement_id, doc_id, relevance_score, confidence) of every item."""
    items, names = _items(spark, sf_dir)
    conf, prior = model(items, names)
    logs = np.log(conf.transpose(0, 2, 1).reshape(-1, GRADES))
    stored = names.index(STORED) if STORED in names else -1
    n_votes = F.size(F.filter("codes", lambda c: F.floor(c / GRADES) != stored))
    out = items.select("statement_id", "doc_id", "codes", "weights", "stored", n_votes.alias("n_votes")).mapInArrow(_graded(logs, prior), "statement_id string, doc_id string, stored int, grade int, confidence double, n_votes int")
    grade = F.when((F.col("n_votes") == 0) & F.col("stored").isNotNull(), F.col("stored")).otherwise(F.col("grade"))
    return out.select("statement_id", "doc_id", grade.cast("int").alias("relevance_score"), "confidence")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grade of every item."""
    return consensus(spark, sf_dir).select("statement_id", "doc_id", "relevance_score")


def p5_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grade of every item with its posterior probability."""
    return consensus(spark, sf_dir)


def p5_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per annotator: the probability that it gives the true grade, weighted by how
    frequent the grades are, and its mean deviation from the true grade."""
    items, names = _items(spark, sf_dir)
    conf, prior = model(items, names)
    lean = (conf * (np.arange(GRADES)[None, None, :] - np.arange(GRADES)[None, :, None])).sum(axis=2) @ prior
    right = (np.diagonal(conf, axis1=1, axis2=2) @ prior) if names else np.zeros(0)
    rows = [(a, float(right[i]), float(lean[i])) for i, a in enumerate(names) if a not in (EXAMINER, STORED)]
    return spark.createDataFrame(rows, "annotator string, reliability double, bias double")


def p5_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: votes (an annotator's equal labels count once), share of agreeing pairs, and the kind of agreement
    (unanimous, majority of at least two, or no_consensus). Null share under two votes."""
    v = raw_votes(spark, sf_dir).groupBy("statement_id", "doc_id", "label").agg(F.count(F.lit(1)).alias("n"))
    per = v.groupBy("statement_id", "doc_id").agg(F.sum("n").alias("n_votes"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"), F.max("n").alias("most"), F.count(F.lit(1)).alias("kinds"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    share = F.when(F.col("n_votes") > 1, F.round(F.col("pairs") / (F.col("n_votes") * (F.col("n_votes") - 1)), 9))
    kind = F.when(F.col("kinds") == 1, "unanimous").when(2 * F.col("most") > F.col("n_votes"), "majority").otherwise("no_consensus")
    return per.select("statement_id", "doc_id", "n_votes", share.alias("agreeing_pairs"), kind.alias("agreement"))


def p5_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fleiss' kappa over all items with at least two votes: observed agreement is the
    mean share of agreeing pairs, expected agreement follows from the grades' shares."""
    v = raw_votes(spark, sf_dir).groupBy("statement_id", "doc_id").agg(*(F.coalesce(F.sum(F.when(F.col("label") == k, 1)), F.lit(0)).alias(f"n{k}") for k in range(GRADES)))
    n = sum((F.col(f"n{k}") for k in range(1, GRADES)), F.col("n0"))
    pairs = sum((F.col(f"n{k}") * (F.col(f"n{k}") - 1) for k in range(1, GRADES)), F.col("n0") * (F.col("n0") - 1))
    per = v.withColumn("n", n).where("n > 1").withColumn("p", pairs / (F.col("n") * (F.col("n") - 1)))
    tot = per.agg(F.count(F.lit(1)).alias("n_items"), F.avg("p").alias("observed"), F.sum("n").alias("n"), *(F.sum(f"n{k}").alias(f"n{k}") for k in range(GRADES)))
    chance = sum((F.pow(F.try_divide(F.col(f"n{k}"), F.col("n")), F.lit(2.0)) for k in range(1, GRADES)), F.pow(F.try_divide(F.col("n0"), F.col("n")), F.lit(2.0)))
    tot = tot.withColumn("expected", chance)
    return tot.select("n_items", F.round("observed", 6).alias("observed"), F.round("expected", 6).alias("expected"), F.round(F.try_divide(F.col("observed") - F.col("expected"), 1 - F.col("expected")), 6).alias("kappa"))


def p5_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The agreement stored with an item against the kind its votes show: items by both (null: none stored, or no votes)."""
    stored = table(spark, sf_dir, "consensus_labels").where("agreement is not null").select(clean_id("statement_id").alias("statement_id"), clean_id("doc_id").alias("doc_id"), "agreement").where("statement_id is not null and doc_id is not null")
    stored = stored.groupBy("statement_id", "doc_id").agg(F.min("agreement").alias("stored"))
    both = stored.join(p5_agreement(spark, sf_dir), ["statement_id", "doc_id"], "full")
    return both.groupBy("stored", F.col("agreement").alias("shown")).agg(F.count(F.lit(1)).alias("n_items"), F.round(F.avg("agreeing_pairs"), 6).alias("agreeing_pairs"))


def queries():
    return {"p5_stale": p5_stale, "p5_found": p5_found, "p5_confidence": p5_confidence, "p5_annotators": p5_annotators, "p5_agreement": p5_agreement, "p5_kappa": p5_kappa}


def _clean(c: str) -> str:
    return f"upper(regexp_replace(regexp_replace({c}, '^[ \\t]+|[ \\t]+$', '', 'g'), '^.*/', ''))"


_SQL = f"""WITH v AS (
  SELECT {_clean('statement_id')} AS s, {_clean('doc_id')} AS d, coalesce(model, '(unknown)') AS a, relevance_score AS label FROM relevance_judgments
  UNION
  SELECT {_clean('statement_id')}, {_clean('doc_id')}, unnest(map_keys(individual_scores)), unnest(map_values(individual_scores)) FROM consensus_labels WHERE individual_scores IS NOT NULL),
u AS (SELECT s, d, label, count(*) AS n FROM v WHERE s IS NOT NULL AND d IS NOT NULL AND label BETWEEN 0 AND 3 GROUP BY ALL),
i AS (SELECT s, d, sum(n) AS n, sum(n * (n - 1)) AS pairs, max(n) AS most, count(*) AS kinds FROM u GROUP BY ALL)
"""


def oracle_sql():
    return {
        "p5_stale": _SQL + f""", a AS (SELECT s, d, CASE WHEN n > 1 THEN round(pairs::DOUBLE / (n * (n - 1))::DOUBLE, 9) END AS agreeing_pairs, CASE WHEN kinds = 1 THEN 'unanimous' WHEN 2 * most > n THEN 'majority' ELSE 'no_consensus' END AS shown FROM i),
b AS (SELECT {_clean('statement_id')} AS s, {_clean('doc_id')} AS d, min(agreement) AS stored FROM consensus_labels WHERE agreement IS NOT NULL AND statement_id IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1, 2)
SELECT stored, shown, count(*) AS n_items, round(avg(agreeing_pairs), 6) AS agreeing_pairs FROM b FULL JOIN a USING (s, d) GROUP BY 1, 2""",
        "p5_agreement": _SQL + """SELECT s AS statement_id, d AS doc_id, n::BIGINT AS n_votes,
  CASE WHEN n > 1 THEN round(pairs::DOUBLE / (n * (n - 1))::DOUBLE, 9) END AS agreeing_pairs,
  CASE WHEN kinds = 1 THEN 'unanimous' WHEN 2 * most > n THEN 'majority' ELSE 'no_consensus' END AS agreement FROM i""",
        "p5_kappa": _SQL + """, o AS (SELECT count(*) AS n_items, avg(pairs::DOUBLE / (n * (n - 1))::DOUBLE) AS observed FROM i WHERE n > 1),
t AS (SELECT label, sum(u.n)::DOUBLE AS m FROM u JOIN i USING (s, d) WHERE i.n > 1 GROUP BY label),
e AS (SELECT sum((m / (SELECT sum(m) FROM t)) ** 2) AS expected FROM t)
SELECT n_items, round(observed, 6) AS observed, round(expected, 6) AS expected, round((observed - expected) / (1 - expected), 6) AS kappa FROM o, e""",
    }
