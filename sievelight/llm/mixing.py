"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws a uniform number from a hash of its id; its key is that number's exponential divided by the document's
quality weight (the share of letters and digits in its words), so the least keys are a weighted sample without replacement. A
source whose target is above its size gives complete epochs first; the rest of its target is a prefix of its documents in key
order, plus the one further document that brings the sum nearest to the target if that is nearer than the prefix alone.

The prefix is found without sorting a source in one task: sizes are summed by key range (partial sums, a number of ranges that
grows with the table), the range that crosses the target is ranked alone, and the outcome is one cut per source. Every row then
decides for itself, so texts are never shuffled, and a source that holds most rows is no heavier than any other.

Defined cases: null texts and texts without words have size 0 and are taken 0 times. A null source is a source, the last. Rows
with equal keys and ids (repeated rows) are taken or left together. A null id draws one number for all null ids. Sources
without words have target 0. Other columns are neither read nor touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD, table, unused, written

WEIGHTS, MOST_EPOCHS, SEED, ROWS_A_RANGE = (1, 2, 3), 3, 17, 10_000
#: Key ranges that are summed together.
SLOTS = 1_000
#: Sources up to which the table of cuts goes to all tasks; past it, it is joined by shuffle.
FEW_SOURCES = 20_000


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def key_of(id_: Column, text: Column, seed: int = SEED) -> Column:
    """Exponential key: -ln(u) / quality weight."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null")))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    text = F.coalesce(text, F.lit(""))
    plain, all_ = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")), F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]", ""))
    weight = F.greatest(F.when(all_ > 0, plain.cast("double") / all_).otherwise(F.lit(1.0)), F.lit(0.05))
    return -F.log(u) / weight


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target, epochs, rest) from (source, source_size). Targets share the total by weight; those above
    ``most`` times their size stop there, in order of cap by weight, and the others share what is left."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("long")
    w = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    before = Window.orderBy(F.col("cap").cast("double") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    left = F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    shares = F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = left.cast("double") / shares.cast("double")
    w = w.withColumn("level", level).withColumn("capped", F.col("level") * F.col("weight") > F.col("cap"))
    free = F.min_by(F.when(~F.col("capped"), F.col("level")), F.when(~F.col("capped"), F.col("cap").cast("double") / F.col("weight"))).over(all_)
    w = w.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(free * F.col("weight")))
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(F.lit(0))
    w = w.withColumn("epochs", epochs.cast("long"))
    return w.select("source", "source_size", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"))


def cuts(rows: DataFrame, ranges: int) -> DataFrame:
    """(source, source_size, target, epochs, at, cut_key, cut_id, add_key, add_id) from (id, source, size, key): documents of key
    ranges before ``at``, those in it up to the cut, and the added one, are taken once more than the epochs."""
    per = written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    slot = F.least(F.floor((1 - F.exp(-F.col("key"))) * ranges), F.lit(ranges - 1)).cast("int")
    some = rows.where("size > 0").withColumn("slot", slot)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    hist = written(some.groupBy("source", "slot").agg(F.sum("size").alias("in_slot")))
    # First the stretch of SLOTS slots that crosses the target, then the slot in it: no task sums all slots of a source.
    stretch = F.floor(F.col("slot") / SLOTS).alias("stretch")
    up_to = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, 0)
    wide = hist.groupBy("source", stretch).agg(F.sum("in_slot").alias("in_it")).withColumn("through", F.sum("in_it").over(up_to("source", "stretch")))
    wide = wide.join(per, same(wide, per)).where("through > rest and through - in_it <= rest").select(wide["source"].alias("src"), F.col("stretch").alias("at_stretch"), (F.col("through") - F.col("in_it")).alias("base"), "rest")
    fine = hist.join(wide, hist["source"].eqNullSafe(F.col("src")) & (F.floor(F.col("slot") / SLOTS) == F.col("at_stretch")))
    fine = fine.withColumn("through", F.col("base") + F.sum("in_slot").over(up_to("source", "slot")))
    crossing = fine.where("through > rest and through - in_slot <= rest").select("src", F.col("slot").alias("at"), (F.col("through") - F.col("in_slot")).alias("before"), "rest")
    inside = some.join(crossing, some["source"].eqNullSafe(F.col("src")) & (F.col("slot") == F.col("at")))
    peers = inside.withColumn("sum", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("key", F.col("id").asc_nulls_first())))
    cut = peers.groupBy("source").agg(F.first("rest").alias("rest"), F.first("at").alias("at"), F.first("before").alias("before"), F.max(F.when(F.col("sum") <= F.col("rest"), F.struct("sum", "key", "id"))).alias("cut"))
    cut = cut.select(F.col("source").alias("src"), "at", "cut", (F.col("rest") - F.coalesce(F.col("cut.sum"), F.col("before"))).alias("gap"))
    cut = written(cut)
    beyond = some.join(cut, some["source"].eqNullSafe(F.col("src")) & ((F.col("slot") > F.col("at")) | (F.col("slot") == F.col("at")) & (F.col("cut").isNull() | (F.col("key") > F.col("cut.key")) | (F.col("key") == F.col("cut.key")) & (F.coalesce("id", F.lit(-(2**63))) > F.coalesce("cut.id", F.lit(-(2**63)))))))
    one = beyond.groupBy("source", "key", "id").agg(F.sum("size").alias("size"), F.first("gap").alias("gap")).where("abs(size - gap) < gap")
    add = one.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("miss"), "key", "id")).alias("add")).withColumnRenamed("source", "asrc")
    out = per.join(cut.drop("gap"), F.col("source").eqNullSafe(F.col("src")), "left").join(add, F.col("source").eqNullSafe(F.col("asrc")), "left")
    return out.select("source", "source_size", "target", "epochs", "at", F.col("cut.key").alias("cut_key"), F.col("cut.id").alias("cut_id"), F.col("add.key").alias("add_key"), F.col("add.id").alias("add_id"))


def rows_of(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col)).alias("size"), key_of(F.col(id_col), F.col(text_col)).alias("key"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, int]:
    """The rows (id, source, size, key), the cuts of their sources, and the number of key ranges."""
    rows = written(rows_of(docs, id_col, text_col, source_col))
    ranges = max(64, -(-rows.count() // ROWS_A_RANGE))
    return rows, written(cuts(rows, ranges)), ranges


def taken(rows: DataFrame, per: DataFrame, ranges: int) -> DataFrame:
    """The rows, which have id, source, size and key, with source_size, target and times (complete documents)."""
    per = per.withColumnRenamed("source", "of_source")
    per = F.broadcast(per) if per.count() <= FEW_SOURCES else per.hint("merge")
    out = rows.join(per, F.col("source").eqNullSafe(F.col("of_source")), "left")
    slot = F.least(F.floor((1 - F.exp(-F.col("key"))) * ranges), F.lit(ranges - 1))
    null_first = lambda c: F.coalesce(c, F.lit(-(2**63)))
    prefix = (slot < F.col("at")) | (slot == F.col("at")) & ((F.col("key") < F.col("cut_key")) | (F.col("key") == F.col("cut_key")) & (null_first(F.col("id")) <= null_first(F.col("cut_id"))))
    added = (F.col("key") == F.col("add_key")) & F.col("id").eqNullSafe(F.col("add_id"))
    more = F.coalesce(prefix, F.lit(False)) | F.coalesce(added, F.lit(False))
    times = F.when(F.col("size") > 0, F.col("epochs") + more.cast("long")).otherwise(F.lit(0))
    return out.withColumn("times", times.cast("long")).drop("of_source", "epochs", "at", "cut_key", "cut_id", "add_key", "add_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = taken(*mix(table(spark, sf_dir, "documents")))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    _, per, ranges = mix(docs)
    name = unused(docs, "row")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name))
    fields = whole.select(name, F.col(f"{name}.doc_id").cast("long").alias("id"), F.col(f"{name}.source").cast("string").alias("source"), size_of(F.col(f"{name}.text")).alias("size"), key_of(F.col(f"{name}.doc_id"), F.col(f"{name}.text")).alias("key"))
    out = taken(fields, per, ranges).where("times > 0")
    return out.select(F.col(name), F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(f"{name}.*")


#: The same in SQL, by one ordered sum per source.
OP8_SQL = r"""
WITH base AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST(('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u,
    length(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}]', '', 'g')) AS plain,
    length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS every
  FROM documents),
d AS (SELECT doc_id, source, size, -ln(u) / greatest(CASE WHEN every > 0 THEN plain::DOUBLE / every ELSE 1 END, 0.05) AS key FROM base),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM w WINDOW b AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, level * weight > cap AS capped FROM l),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE
    ELSE (SELECT arg_min(level, cap::DOUBLE / weight) FROM c WHERE NOT capped) * weight END AS target FROM c),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS epochs FROM t),
o AS (SELECT d.*, source_size, target, epochs, target - epochs * source_size AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST) AS through
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
g AS (SELECT source, max(rest) - coalesce(max(through) FILTER (through <= rest), 0) AS gap FROM o GROUP BY source),
p AS (SELECT o.source, o.key, o.doc_id, sum(size) AS size, max(gap) AS gap FROM o JOIN g ON o.source IS NOT DISTINCT FROM g.source
  WHERE size > 0 AND through > rest GROUP BY ALL),
a AS (SELECT source, key, doc_id FROM p WHERE abs(size - gap) < gap
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(size - gap), key, doc_id NULLS FIRST) = 1)
SELECT o.doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN through <= rest OR a.key IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM o LEFT JOIN a ON o.source IS NOT DISTINCT FROM a.source AND o.key = a.key AND o.doc_id IS NOT DISTINCT FROM a.doc_id
"""
