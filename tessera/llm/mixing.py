"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each document of a source has the same number of expected copies, target over
source size. The documents stand in the order (size, bucket, id); their
expected copies are summed up from the start of the source, one random offset
(fixed by a seed and the source's name) is added, and a document is emitted
once for every integer that its step crosses. As neighbours have like sizes,
the words taken stay within about one long document of the target.

Prefix sums never gather a source in one task: ranks are put together from
three levels of counts, (source, size), (source, size, bucket) and the rows of
a bucket. A bucket is a hash of the id in 4096 parts, so a source whose
documents are all of one size is still dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.text import WORD, word_count
from tessera.sources.shared import cut
from tessera.sources.tables import table


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets of sources from (key, source, source_size, source_docs).

    Sources in code point order, null last, weigh ``weights`` in turn and share
    ``share`` of all words. A target stops at ``cap`` times its source's size and
    the excess is shared again by weight: that is one water level, found by a
    prefix sum over sources in the order of cap / weight. One row per source
    (as many rows as there are names), so one task holds them.
    """
    n = len(weights)
    order = Window.orderBy(F.col("source").isNull(), "source")
    weigh = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(order) - 1) % n + 1)
    level = Window.orderBy(F.col("source_size") / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = sizes.withColumn("weight", weigh.cast("long"))
    w = w.withColumns({
        "size_below": F.sum("source_size").over(level) - F.col("source_size"),
        "weight_from": F.sum("weight").over(every) - (F.sum("weight").over(level) - F.col("weight")),
        "total": F.sum("source_size").over(every),
    })
    # the level if exactly the sources before this one are full; the first that stays below its cap sets it
    w = w.withColumn("at", (F.lit(share) * F.col("total") - F.lit(cap) * F.col("size_below")) / F.col("weight_from"))
    free = F.col("at") * F.col("weight") < F.lit(cap) * F.col("source_size")
    w = w.withColumn("lambda", F.max(F.when(free, F.struct(-F.col("size_below"), -F.col("weight"), F.col("at")))).over(every)["at"])
    target = F.when(F.col("lambda").isNull(), F.lit(cap) * F.col("source_size")).otherwise(
        F.least(F.lit(cap) * F.col("source_size"), F.col("lambda") * F.col("weight"))
    )
    return w.select("key", "source_size", target.cast("double").alias("target"))


def mix_plan(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix", carry: tuple[str, ...] = ()
) -> DataFrame:
    """Each document's ``size``, ``source_size``, ``target`` and ``copies`` (0 to ``ceil(cap)``).

    ``carry`` names further columns to bring along. Null text has size 0; null
    source is a source of its own, the last; null ids count as rows like any
    other. Rows that are equal in id, source and size take their places in an
    order fixed by the carried columns. An empty table gives no rows. A source
    without words has target 0 and none of its documents is taken.
    """
    tie = F.xxhash64(*carry) if carry else F.lit(0)
    rows = docs.select(
        "doc_id", "source", *carry, word_count(F.col("text")).alias("size"), _key(F.col("source")).alias("key"),
        F.coalesce(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 3), F.lit("")).alias("bucket"), tie.alias("tie"),
    )
    if not carry:
        rows = cut(rows, "mix-sizes")
    cells = rows.groupBy("key", "source", "size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    sizes = cells.groupBy("key", "source", "size").agg(F.sum("n").alias("n"))
    sources = sizes.groupBy("key", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    before = lambda keys, by: F.sum("n").over(Window.partitionBy(*keys).orderBy(by)) - F.col("n")
    start = sizes.select("key", "size", before(["key"], "size").alias("at_size"))
    place = cells.select("key", "size", "bucket", before(["key", "size"], "bucket").alias("at_bucket")).join(start, ["key", "size"])
    place = place.join(source_targets(sources, weights, share, cap), "key")
    out = rows.withColumn("r", F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("doc_id", "tie")))
    out = out.join(place, ["key", "size", "bucket"])
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "key")), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = F.col("at_size") + F.col("at_bucket") + F.col("r")
    copies = F.floor(rate * rank + offset) - F.floor(rate * (rank - 1) + offset)
    return out.select("doc_id", "source", *carry, "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every row of ``docs``, all columns kept, as often as the plan says."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "source"))
    named = {c: f"_carry{i}" for i, c in enumerate(rest)}
    plain = docs.select("doc_id", "source", "text", *[F.col(f"`{c}`").alias(a) for c, a in named.items()])
    out = mix_plan(plain, carry=tuple(named.values()), **how).filter("copies > 0")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    back = {a: c for c, a in named.items()} | {"doc_id": "doc_id", "source": "source"}
    place = {c: a for a, c in back.items()}
    return out.select(*[F.col(place[c]).alias(c) for c in docs.columns])


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` at weights 5, 2, 1 and 150 % of all words."""
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP2_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS k,
         coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         coalesce(substr(md5(doc_id::VARCHAR), 1, 3), '') AS bucket
  FROM documents),
s AS (
  SELECT k, source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3] AS w
  FROM d GROUP BY k, source),
level AS (
  SELECT 0 AS round, k, source_size, w, false AS full_up,
         1.5 * sum(source_size) OVER () / sum(w) OVER () AS lv FROM s
  UNION ALL
  SELECT round + 1, k, source_size, w, full_up,
         (1.5 * sum(source_size) OVER () - sum(CASE WHEN full_up THEN 2.0 * source_size ELSE 0 END) OVER ())
         / nullif(sum(CASE WHEN full_up THEN 0 ELSE w END) OVER (), 0)
  FROM (SELECT round, k, source_size, w, lv * w >= 2.0 * source_size AS full_up,
               max(CASE WHEN lv * w >= 2.0 * source_size AND NOT full_up THEN 1 ELSE 0 END) OVER () AS changed FROM level)
  WHERE changed = 1),
t AS (
  SELECT k, source_size, CASE WHEN full_up THEN 2.0 * source_size ELSE lv * w END::DOUBLE AS target
  FROM level WHERE round = (SELECT max(round) FROM level)),
r AS (
  SELECT d.*, row_number() OVER (PARTITION BY k ORDER BY size, bucket, doc_id NULLS FIRST) AS r FROM d),
c AS (
  SELECT doc_id, size, source_size, target, r,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix:' || k), 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE AS u
  FROM r JOIN t USING (k))
SELECT doc_id, size, source_size, target,
       ((floor(rate * r + u) - floor(rate * (r - 1) + u))::BIGINT * size) AS taken
FROM c
"""
