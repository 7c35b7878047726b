"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a keyed random order, offered `max_repeats` times over. A copy's virtual
finish time is the source's cumulative size up to and with it, divided by the source's weight. All copies are
range-sorted by finish time and the order is truncated at the total budget, so sources advance in proportion to their weights
and one that runs out leaves its share to the others: the result meets the water-filled targets to about a document.

No task holds a whole source, and nothing goes to the driver but the number of rows. Every cumulative sum is taken in two levels: rows are
dealt into even ranges of the order, whose bounds Spark samples, a range's own sum goes over its rows, and what lies before it
comes from a table of the ranges' totals. Sources, their targets and the queue are all made in this way, however many there are.

Defined cases: null text has size 0; null source is one source, last in the order; documents of size 0 are never
taken (they hold no words); an empty table gives no rows; of repeated doc_ids, null ones too, each row is a document of its own, in the
order of a hash of its columns; a column of docs that is named as one of the results is left out of `row`'s place, not mixed up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, spread

#: Rows of a range, about.
RANGE_ROWS = 50_000
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def cyclic_weight(place: Column) -> Column:
    """1, 2, 3, repeating, for sources in code point order (places from 1), null last."""
    return ((place - 1) % 3 + 1).cast("double")


def running(df: DataFrame, order: list[str], sums: dict[str, str], rows: int) -> DataFrame:
    """df with sums[name], the sum of column `name` over the rows up to and with each, in the order of columns that tell rows apart.

    Nulls come last. `rows` is about how many there are. The ranges are even whatever the values: Spark samples their bounds.
    """
    ranges = max(1, min(4 * spread(df.sparkSession), -(-rows // RANGE_ROWS)))
    keys = [F.col(c).asc_nulls_last() for c in order]
    dealt = materialize(df.repartitionByRange(ranges, *keys).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"__{c}") for c in sums])  # a row a range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("_range").alias("_r"), *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in sums])
    inside = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumns({out: F.sum(c).over(inside) for c, out in sums.items()})
    met = own.join(F.broadcast(totals), F.col("_range") == F.col("_r"))  # as many rows as ranges
    return met.withColumns({out: F.col(out) + F.col(f"__{c}") for c, out in sums.items()}).drop("_range", "_r", *[f"__{c}" for c in sums])


def source_targets(sizes: DataFrame, share: float, most: int, weight, rows: int) -> DataFrame:
    """sizes(source, size), a row a source -> source, source_size, weight, target, before (the sizes of sources before it), budget.

    Water-filling: in the order of size by weight, sources are full (`most` times their size) until the rest of the budget, dealt by weight
    among those that are left, fills no more.
    """
    named = running(sizes.withColumn("one", F.lit(1).cast("long")), ["source"], {"one": "place", "size": "upto"}, rows)
    named = named.select("source", F.col("size").alias("source_size"), (F.col("upto") - F.col("size")).alias("before"), weight(F.col("place")).alias("weight"))
    named = materialize(named.withColumns({"full": most * F.col("source_size"), "level": most * F.col("source_size") / F.col("weight")}), "sources")
    whole = named.agg((F.lit(share) * F.sum("source_size")).cast("long").alias("budget"), F.sum("weight").alias("_all"))  # one row
    filled = running(named, ["level", "source"], {"full": "_full", "weight": "_weight"}, rows).crossJoin(F.broadcast(whole))
    rest, left = F.col("budget") - (F.col("_full") - F.col("full")), F.col("_all") - (F.col("_weight") - F.col("weight"))
    filled = materialize(filled.withColumns({"_rest": rest.cast("double"), "_left": left}), "filled")
    open_ = filled.filter(F.col("_rest") * F.col("weight") / F.col("_left") <= F.col("full"))
    cut = open_.agg(F.min(F.struct("level", F.col("source").isNull().alias("_n"), "source", "_rest", "_left")).alias("c"))  # one row
    met = filled.drop("_rest", "_left").crossJoin(F.broadcast(cut))
    last = F.col("source").isNull()
    is_full = F.col("c").isNull() | (F.struct("level", last.alias("_n"), "source") < F.struct("c.level", "c._n", "c.source"))
    target = F.when(is_full, F.col("full").cast("double")).otherwise(F.col("c._rest") * F.col("weight") / F.col("c._left"))
    return met.select("source", "source_size", "weight", target.alias("target"), "before", "budget")


def mix(docs: DataFrame, size: Column, weight=cyclic_weight, share: float = 1.0, max_repeats: int = 3, key: str = "mix", carry: bool = False) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken (words, repeats counted).

    docs needs doc_id and source; size gives a document's words; weight turns a source's place into its weight; the budget is
    `share` of all words. With `carry` the document's own columns come along as the struct `row`: doc_id need not tell rows apart.
    """
    row = [F.struct(*docs.columns).alias("row")] if carry else []
    kinds = dict(docs.dtypes)
    tie = F.xxhash64(*[F.col(c) for c in docs.columns if not kinds[c].startswith(("map", "variant"))])
    base = docs.select("doc_id", "source", size.alias("size"), tie.alias("tie"), *row).withColumn("lot", F.md5(F.concat_ws(":", F.lit(key), F.col("doc_id").cast("string"))))
    base = materialize(base.withColumn("uid", F.monotonically_increasing_id()), "mix")  # read several times, and uid must not change
    n = base.count()
    sizes = materialize(base.groupBy("source").agg(F.sum("size").alias("size")), "sizes")
    info = materialize(source_targets(sizes, share, max_repeats, weight, sizes.count()), "targets")
    meta = info.withColumnRenamed("source", "_source")

    queued = running(base.filter("size > 0").drop("row"), ["source", "lot", "doc_id", "size", "tie", "uid"], {"size": "upto"}, n)
    queued = queued.join(meta, F.col("source").eqNullSafe(F.col("_source")))
    copies = queued.select("uid", "lot", "doc_id", "size", "tie", "weight", "budget", "source_size", (F.col("upto") - F.col("before")).alias("upto"), F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("copy"))
    copies = copies.select("uid", "lot", "doc_id", "size", "tie", "copy", "budget", ((F.col("upto") + F.col("copy") * F.col("source_size")).cast("double") / F.col("weight")).alias("finish"))
    reached = running(copies, ["finish", "lot", "doc_id", "size", "tie", "uid", "copy"], {"size": "at"}, n * max_repeats)
    taken = reached.filter("at <= budget").groupBy(F.col("uid").alias("_d")).agg(F.sum("size").alias("_taken"))
    out = base.join(meta, F.col("source").eqNullSafe(F.col("_source"))).join(taken, F.col("uid") == F.col("_d"), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"), *(["row"] if carry else []))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, word_count(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('mix:' || doc_id::VARCHAR) AS lot FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM d GROUP BY source),
b AS (SELECT sum(source_size)::BIGINT AS budget FROM s),
o AS (SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
    sum(weight) OVER (ORDER BY 3 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left,
    row_number() OVER (ORDER BY 3 * source_size / weight, source) AS k FROM s),
c AS (SELECT min(k) AS k FROM o, b WHERE (budget - full_before)::DOUBLE * weight / weight_left <= 3 * source_size),
l AS (SELECT (budget - full_before)::DOUBLE AS rest, weight_left FROM o, b, c WHERE o.k = c.k),
t AS (SELECT o.source, o.source_size, o.weight, CASE WHEN o.k < c.k THEN (3 * o.source_size)::DOUBLE ELSE rest * o.weight / l.weight_left END AS target FROM o, c, l),
q AS (SELECT d.doc_id, d.lot, d.size, t.source_size, t.target, t.weight,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.lot, d.doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT q.*, e.copy, (upto + e.copy * source_size)::DOUBLE / weight AS finish FROM q, (VALUES (0), (1), (2)) e(copy) WHERE size > 0),
g AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, lot, doc_id, copy ROWS UNBOUNDED PRECEDING) AS reached FROM p),
k AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM g, b WHERE reached <= budget GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0)::BIGINT AS taken FROM q LEFT JOIN k USING (doc_id)
"""
