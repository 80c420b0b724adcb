"""Deterministic order, top-k per group, windows over rankings, samples and splits."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.catalog import Catalogue, rel, withs
from ..plans.shared import materialize
from ..sources.tables import table

CAT = Catalogue()
queries, oracle_sql = CAT.queries, CAT.oracle_sql


def hash_order(id_col: str, seed: int) -> list[Column]:
    """A reproducible random order: md5 of seed and id, the id itself at last."""
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))).asc(), F.col(id_col).asc()]


def by_score(score: str = "score", doc: str = "doc_id") -> list[Column]:
    """Score descending, to nine digits, so that sums in another order don't matter; then the id."""
    return [F.round(F.col(score), 9).desc(), F.col(doc).asc()]


def ranked(df: DataFrame, groups: list[str], order: list[Column], k: int | None = None) -> DataFrame:
    """``rank`` within each group; with k the planner cuts groups before the shuffle."""
    r = df.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return r if k is None else r.where(F.col("rank") <= k)


@CAT.query("top_k_run", withs("scored") + "SELECT * FROM (SELECT system, query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY system, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored) WHERE rank <= 5")
def _top(spark, d):
    return ranked(rel(spark, d, "scored"), ["system", "query_id"], by_score(), 5).withColumn("score", F.round("score", 6))


@CAT.query("top_k_type_filter", withs("scored", "doc_types") + """, a AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM (SELECT query_id, doc_id, avg(score) AS score FROM scored GROUP BY 1, 2)),
b AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM a JOIN doc_types USING (doc_id) WHERE r <= 9 AND doc_type = 'patent') SELECT query_id, doc_id, rank FROM b WHERE rank <= 3""")
def _typed(spark, d):
    # over-fetch three times, filter by type, rank again: may give fewer than k
    s = rel(spark, d, "scored").groupBy("query_id", "doc_id").agg(F.avg("score").alias("score"))
    top = ranked(s, ["query_id"], by_score(), 9).withColumnRenamed("rank", "r")
    kept = top.join(rel(spark, d, "doc_types").where("doc_type = 'patent'").select("doc_id"), "doc_id")
    return ranked(kept, ["query_id"], [F.col("r").asc()], 3).select("query_id", "doc_id", "rank")


@CAT.query("top_patents", withs("links") + ", p AS (SELECT patent_id, count(*) AS n FROM links GROUP BY 1) SELECT patent_id, n FROM p QUALIFY (SELECT count(*) FROM p) <= 100 OR row_number() OVER (ORDER BY n DESC, patent_id) <= 150")
def _patents(spark, d):
    return most_cited(rel(spark, d, "links"), "patent_id", 50)


def most_cited(df: DataFrame, key: str, target: int) -> DataFrame:
    """Keys by their number of rows: all, or three times the target if there are more than twice as many."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    top = n.orderBy(F.desc("n"), F.asc(key)).limit(3 * target)
    total = n.agg(F.count(F.lit(1)).alias("_t"))  # one row
    few = n.crossJoin(F.broadcast(total)).where(F.col("_t") <= 2 * target).drop("_t")
    return top.unionByName(few).distinct()


@CAT.query("top_docs_grade", withs("qrels") + "SELECT query_id, doc_id, relevance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS rank FROM qrels) WHERE rank <= 5")
def _grade(spark, d):
    return ranked(rel(spark, d, "qrels"), ["query_id"], [F.desc("relevance"), F.asc("doc_id")], 5)


@CAT.query("win_keep_max", withs("links") + "SELECT patent_id, paper_id, max(confidence) AS confidence, 1 AS relevance FROM links WHERE confidence >= 8 GROUP BY 1, 2")
def _max(spark, d):
    # the best row's value alone is asked for: a maximum, no window
    return rel(spark, d, "links").where("confidence >= 8").groupBy("patent_id", "paper_id").agg(F.max("confidence").alias("confidence")).withColumn("relevance", F.lit(1))


@CAT.query("win_source_priority", withs("links") + "SELECT patent_id, paper_id, source, confidence FROM (SELECT *, row_number() OVER (PARTITION BY patent_id, paper_id ORDER BY CASE source WHEN 'examiner' THEN 3 WHEN 'applicant' THEN 2 ELSE 1 END DESC, confidence DESC, query_id) AS r FROM links) WHERE r = 1")
def _priority(spark, d):
    # the first by a composite key is a maximum of structs, combined before the shuffle
    rank = F.when(F.col("source") == "examiner", 3).when(F.col("source") == "applicant", 2).otherwise(1)
    best = rel(spark, d, "links").groupBy("patent_id", "paper_id").agg(F.max(F.struct(rank.alias("r"), "confidence", "source")).alias("m"))
    return best.select("patent_id", "paper_id", F.col("m.source").alias("source"), F.col("m.confidence").alias("confidence"))


@CAT.query("win_rank", withs("scored", "qrels") + """, r AS (SELECT *, row_number() OVER (PARTITION BY system, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored), p AS (SELECT s.system, q.query_id, q.doc_id FROM qrels q CROSS JOIN (SELECT DISTINCT system FROM scored) s WHERE q.relevance >= 2)
SELECT p.system, p.query_id, p.doc_id, r.rank FROM p LEFT JOIN r USING (system, query_id, doc_id) WHERE r.rank IS NULL OR r.rank > 3""")
def _failures(spark, d):
    s = rel(spark, d, "scored")
    r = ranked(s, ["system", "query_id"], by_score()).select("system", "query_id", "doc_id", "rank")
    systems = s.agg(F.collect_set("system").alias("systems"))  # one row; systems are compared by name
    p = rel(spark, d, "qrels").where("relevance >= 2").select("query_id", "doc_id").crossJoin(F.broadcast(systems)).select("query_id", "doc_id", F.explode("systems").alias("system"))
    return p.join(r, ["system", "query_id", "doc_id"], "left").where("rank is null or rank > 3").select("system", "query_id", "doc_id", "rank")


@CAT.query("win_minmax", withs("scored") + "SELECT system, query_id, doc_id, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS score FROM scored WINDOW w AS (PARTITION BY system, query_id)")
def _minmax(spark, d):
    return min_max(rel(spark, d, "scored")).withColumn("score", F.round("score", 6))


def min_max(run: DataFrame, groups: tuple[str, ...] = ("system", "query_id")) -> DataFrame:
    """Scores scaled to 0..1 within a group; equal scores give 1."""
    w = Window.partitionBy(*groups)
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return run.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("score", F.when(F.col("_hi") == F.col("_lo"), 1.0).otherwise((F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))).drop("_lo", "_hi")


@CAT.query("win_avg_rank", withs("scored") + "SELECT system, query_id, doc_id, rank() OVER w + (count(*) OVER (PARTITION BY system, query_id, round(score, 9)) - 1) / 2.0::DOUBLE AS rank FROM scored WINDOW w AS (PARTITION BY system, query_id ORDER BY round(score, 9))")
def _avg_rank(spark, d):
    return average_ranks(rel(spark, d, "scored"), ["system", "query_id"], F.round("score", 9)).select("system", "query_id", "doc_id", "rank")


def average_ranks(df: DataFrame, groups: list[str], value: Column, name: str = "rank") -> DataFrame:
    """Ranks ascending, ties sharing their mean rank."""
    v = df.withColumn("_v", value)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*groups, "_v"))
    return v.withColumn(name, (F.rank().over(Window.partitionBy(*groups).orderBy("_v")) + (ties - 1) / F.lit(2.0)).cast("double")).drop("_v")


@CAT.query("win_percentile_norm", """WITH e AS (SELECT event_type, event_id, value, quantile_cont(value, [0.05, 0.95]) OVER w AS q, count(*) OVER w AS n FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 1000 PRECEDING AND 1 PRECEDING))
SELECT event_id, round(CASE WHEN n < 10 THEN CASE WHEN value > 1 THEN least(value / 25, 1.0) ELSE value END WHEN q[2] <= q[1] THEN 0.5 ELSE greatest(0.0, least(1.0, (value - q[1]) / (q[2] - q[1]))) END, 6) AS score FROM e""")
def _percentile(spark, d):
    """A value's place between the 5th and 95th percentile of the thousand before it."""
    e = table(spark, d, "events").where("value is not null").select("event_type", "event_id", "value")
    e = moving_percentiles(e, "event_type", "event_id", "value", (0.05, 0.95), 1000)
    lo, hi, v = F.col("q")[0], F.col("q")[1], F.col("value")
    few = F.when(v > 1, F.least(v / 25, F.lit(1.0))).otherwise(v)
    return e.select("event_id", F.round(F.when(F.col("n") < 10, few).when(hi <= lo, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - lo) / (hi - lo)))), 6).alias("score"))


def positions(df: DataFrame, group: str, order: str, tag: str) -> DataFrame:
    """``pos`` of each row within its group in the order, from 0: ranges of the order are counted first, so no group is one task."""
    parts = materialize(df.repartitionByRange(group, order).sortWithinPartitions(group, order).withColumn("_part", F.spark_partition_id()), tag)
    counts = parts.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_q")).agg(F.count(F.lit(1)).alias("_m"))
    w = Window.partitionBy("_g").orderBy("_q").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row per group and range
    counts = counts.select("_g", "_q", (F.sum("_m").over(w) - F.col("_m")).alias("_before"))
    j = parts.join(counts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_q")))
    r = F.row_number().over(Window.partitionBy("_g", "_q").orderBy(order))
    return j.withColumn("pos", F.col("_before") + r - 1).drop("_g", "_q", "_part", "_before")


#: Rows of a group that one task works on; as many as ``back`` of the block before come with them.
MOVING_BLOCK = 20_000


def moving_percentiles(df: DataFrame, group: str, order: str, value: str, at: tuple[float, ...], back: int) -> DataFrame:
    """The rows with ``q`` (percentiles of the up to ``back`` rows before in the group's order, interpolated) and ``n`` (how
    many those are). Groups are cut into blocks of positions, and the rows a block looks back on are sent to it too."""
    block = max(MOVING_BLOCK, back)
    p = positions(df.select(group, order, value), group, order, "moving")
    k = F.floor(F.col("pos") / block)
    mine = F.when(F.col("pos") % block >= block - back, F.array(k, k + 1)).otherwise(F.array(k))
    dealt = p.withColumn("_block", F.explode(mine))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", kind="stable")
        first = int(rows["_block"].iloc[0]) * block
        ring: deque = deque()
        held: list[float] = []
        q, n = [], []
        for pos, v in zip(rows["pos"], rows[value]):
            if pos >= first:
                n.append(len(held))
                q.append([_between(held, x) for x in at] if held else [None] * len(at))
            ring.append(v)
            insort(held, v)
            if len(ring) > back:
                held.pop(bisect_left(held, ring.popleft()))
        own = rows[rows["pos"] >= first]
        return own[[group, order, value]].assign(q=pd.Series(q, index=own.index, dtype=object), n=pd.Series(n, index=own.index, dtype="int64"))

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return dealt.groupBy(group, "_block").applyInPandas(run, f"{group} {kinds[group]}, {order} {kinds[order]}, {value} {kinds[value]}, q array<double>, n bigint")


def _between(held: list[float], p: float) -> float:
    k = p * (len(held) - 1)
    lo = int(k)
    return held[lo] + (k - lo) * (held[min(lo + 1, len(held) - 1)] - held[lo])


def hash_ranked(df: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """``_r``, the rank in hash order within the group, and ``_n``, the group's rows. Rows are sorted within
    a prefix of the hash only, 4,096 to a group, and ranks go on from the counts of the prefixes
    before, so no group is sorted by one task. Nulls are a group."""
    h = hash_order(key, seed)
    p = df.withColumn("_p", F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 3))
    w = Window.partitionBy("_g").orderBy("_q")
    counts = p.groupBy(F.col(group).alias("_g"), F.col("_p").alias("_q")).agg(F.count(F.lit(1)).alias("_m"))
    counts = counts.select("_g", "_q", F.sum("_m").over(Window.partitionBy("_g")).alias("_n"), (F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_m")).alias("_before"))
    j = p.join(counts, F.col(group).eqNullSafe(F.col("_g")) & F.col("_p").eqNullSafe(F.col("_q")))
    r = F.row_number().over(Window.partitionBy("_g", "_q").orderBy(*h))
    return j.withColumn("_r", F.col("_before") + r).drop("_g", "_q", "_p", "_before")


def split_by_share(df: DataFrame, key: str, stratum: str, seed: int = 42, train: float = 0.7, dev: float = 0.15) -> DataFrame:
    """``split`` per row: within each stratum, in hash order, floored shares; strata of three
    and more have at least one train and one dev row, smaller ones are all train."""
    r = hash_ranked(df, stratum, key, seed)
    a = F.greatest(F.lit(1), F.floor(F.col("_n") * train))
    b = F.greatest(F.lit(1), F.floor(F.col("_n") * dev))
    return r.withColumn("split", F.when((F.col("_n") < 3) | (F.col("_r") <= a), "train").when(F.col("_r") <= a + b, "dev").otherwise("test")).drop("_n", "_r")


_SPLIT = "CASE WHEN n < 3 OR r <= greatest(1, floor(n * 0.7)) THEN 'train' WHEN r <= greatest(1, floor(n * 0.7)) + greatest(1, floor(n * 0.15)) THEN 'dev' ELSE 'test' END"


@CAT.query("win_kept_positions", withs("claims") + f", x AS (SELECT query_id, domain, count(*) OVER (PARTITION BY domain) AS n, row_number() OVER (PARTITION BY domain ORDER BY md5('42:' || query_id), query_id) AS r FROM claims) SELECT query_id, domain, {_SPLIT} AS split FROM x")
def _positions(spark, d):
    return split_by_share(rel(spark, d, "claims").select("query_id", "domain"), "query_id", "domain")


@CAT.query("win_split_patent", withs("claims") + f", p AS (SELECT patent_id, min(domain) AS domain FROM claims GROUP BY 1), x AS (SELECT patent_id, count(*) OVER (PARTITION BY domain) AS n, row_number() OVER (PARTITION BY domain ORDER BY md5('42:' || patent_id), patent_id) AS r FROM p) SELECT query_id, {_SPLIT} AS split FROM claims JOIN x USING (patent_id)")
def _split_patent(spark, d):
    c = rel(spark, d, "claims")
    p = split_by_share(c.groupBy("patent_id").agg(F.min("domain").alias("domain")), "patent_id", "domain").select("patent_id", "split")
    return c.select("patent_id", "query_id").join(p, "patent_id").select("query_id", "split")


@CAT.query("win_refinement", withs("scored", "qrels") + """, s AS (SELECT DISTINCT query_id, doc_id, dense_rank() OVER (ORDER BY system) AS step FROM scored), f AS (SELECT query_id, doc_id, min(step) AS step FROM s GROUP BY 1, 2), t AS (SELECT count(*) AS n FROM qrels WHERE relevance > 0),
h AS (SELECT step, count(*) AS hits FROM f JOIN qrels q USING (query_id, doc_id) WHERE q.relevance > 0 GROUP BY 1) SELECT step, round(sum(hits) OVER (ORDER BY step)::DOUBLE / n, 6) AS recall FROM h, t""")
def _refinement(spark, d):
    s = rel(spark, d, "scored")
    steps = s.select("system").distinct().withColumn("step", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("system")))  # one row per system
    first = s.join(F.broadcast(steps), "system").groupBy("query_id", "doc_id").agg(F.min("step").alias("step"))
    pos = rel(spark, d, "qrels").where("relevance > 0").select("query_id", "doc_id")
    hits = first.join(pos, ["query_id", "doc_id"]).groupBy("step").agg(F.count(F.lit(1)).alias("hits"))
    total = pos.agg(F.count(F.lit(1)).alias("n"))
    run = F.sum("hits").over(Window.partitionBy(F.lit(1)).orderBy("step"))
    return hits.crossJoin(F.broadcast(total)).select("step", F.round(run / F.col("n"), 6).alias("recall"))


# --- samples -------------------------------------------------------------------------------


def stratified(df: DataFrame, key: str, stratum: str, target: int, seed: int = 42) -> DataFrame:
    """A sample in proportion to the strata, at least one each, trimmed to the target."""
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_t"))
    take = sizes.crossJoin(F.broadcast(total)).select(stratum, F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(float(target)) / F.col("_t"))).alias("_k"))
    r = ranked(df, [stratum], hash_order(key, seed), target).join(take, stratum)  # no stratum takes more than the target
    return r.where("rank <= _k").drop("rank", "_k").orderBy(*hash_order(key, seed)).limit(target)


_STR = ", z AS (SELECT {g}, count(*) AS n FROM {t} GROUP BY 1), k AS (SELECT {g}, greatest(1, floor(n * {m}.0::DOUBLE / (SELECT sum(n) FROM z))) AS k FROM z), x AS (SELECT {i}, {g}, row_number() OVER (PARTITION BY {g} ORDER BY md5('42:' || {i}), {i}) AS r FROM {t}) SELECT {i}, {g} FROM x JOIN k USING ({g}) WHERE r <= k ORDER BY md5('42:' || {i}), {i} LIMIT {m}"


@CAT.query("smp_stratified", withs("claims") + _STR.format(g="domain", t="claims", i="query_id", m=500))
def _stratified(spark, d):
    return stratified(rel(spark, d, "claims").select("query_id", "domain"), "query_id", "domain", 500)


@CAT.query("smp_patents", withs("claims") + ", p AS (SELECT patent_id, min(domain) AS domain FROM claims GROUP BY 1)" + _STR.format(g="domain", t="p", i="patent_id", m=200))
def _smp_patents(spark, d):
    return stratified(rel(spark, d, "claims").groupBy("patent_id").agg(F.min("domain").alias("domain")).select("patent_id", "domain"), "patent_id", "domain", 200)


@CAT.query("smp_domain_quota", withs("q1") + ", x AS (SELECT query_id, domain, row_number() OVER (PARTITION BY domain ORDER BY md5('42:' || query_id), query_id) AS r FROM q1), t(domain, share) AS (VALUES ('oncology', 0.4), ('diagnostics', 0.3), ('enzymes', 0.3)) SELECT query_id, domain FROM x JOIN t USING (domain) WHERE r <= greatest(1, round(50 * share))")
def _quota(spark, d):
    q = rel(spark, d, "q1").select("query_id", "domain")
    share = F.when(F.col("domain") == "oncology", 0.4).when(F.col("domain").isin("diagnostics", "enzymes"), 0.3)
    r = ranked(q.where("domain in ('oncology', 'diagnostics', 'enzymes')"), ["domain"], hash_order("query_id", 42))
    return r.where(F.col("rank") <= F.greatest(F.lit(1.0), F.round(50 * share))).select("query_id", "domain")


@CAT.query("smp_negatives", withs("papers1") + "SELECT paper_id FROM papers1 WHERE length(abstract) > 200 AND cited_by_count = 0 ORDER BY md5('42:' || paper_id), paper_id LIMIT 60")
def _smp_negatives(spark, d):
    return rel(spark, d, "papers1").where("length(abstract) > 200 and cited_by_count = 0").orderBy(*hash_order("paper_id", 42)).limit(60).select("paper_id")


@CAT.query("smp_queries", withs("q1") + "SELECT query_id FROM q1 ORDER BY md5('42:' || query_id), query_id LIMIT 100")
def _smp_queries(spark, d):
    return rel(spark, d, "q1").select("query_id").orderBy(*hash_order("query_id", 42)).limit(100)
