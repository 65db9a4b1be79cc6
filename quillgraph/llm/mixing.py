"""Mixing sources to target weights.

Sizes are summed by source, each source gets a target, and target over size is its repetition rate.
A document is emitted floor(rate) times, and once more with the fraction as probability; the draw is
a hash of the document's id and a seed, so reruns agree.

Targets: a source's share of `total_ratio` times all sizes goes by weight, but no further than
`most_repeats` times its own size; what is above goes to the others by weight until none is above.
That is the water level L with sum(min(cap, L * weight)) = total, found by one sorted running sum.

Defined results: null text has size 0; null source is a source of its own, the last; null ids draw as
the text "null"; equal rows draw alike. A source without words has target 0. An empty table gives an
empty table. Columns of the input other than those added pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, packed, unpacked, word_count

#: Weights by the source's place in code point order, repeating.
WEIGHTS = (5, 2, 1)


def source_targets(sized: DataFrame, source: str, size: str, weights=WEIGHTS, total_ratio: float = 1.5, most_repeats: float = 2.0) -> DataFrame:
    """(source, source_size, target): one row per source. The windows run over sources, not documents."""
    per = sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most_repeats))).withColumn("full_at", F.col("cap") / F.col("weight"))
    rising = Window.orderBy("full_at", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) * F.lit(float(total_ratio)) - F.coalesce(F.sum("cap").over(rising), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(rising), F.lit(0.0)))
    per = per.withColumn("level", level)
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(every)["level"]
    return per.select("source", "source_size", F.coalesce(F.least("cap", level * F.col("weight")), F.col("cap")).alias("target"))


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) from a hash of the key: 52 bits of MD5."""
    digest = F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), F.lit(seed)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def with_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix-1", **targets) -> DataFrame:
    """One row per document: (doc_id, source, size, source_size, target, copies)."""
    sized = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")))
    per = source_targets(sized, "source", "size", **targets).withColumnRenamed("source", "of")
    both = sized.join(per, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    extra = F.when(draw(F.col("doc_id"), seed) < rate - F.floor(rate), 1).otherwise(0)
    return both.withColumn("copies", (F.floor(rate) + extra).cast("int"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix-1", **targets) -> DataFrame:
    """The mix itself: every document as often as its copies say, with the columns of the input.

    Rates are joined by source, so the texts are neither shuffled nor collected: the table of sources
    is broadcast while its size is below Spark's checked threshold; beyond it the join is by key.
    """
    sized = cut(docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size")).groupBy("source").agg(F.sum("size").alias("size")))
    per = source_targets(sized, "source", "size", **targets)
    per = cut(per.select(F.col("source").alias("_of"), F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)).alias("_rate")))
    given = docs.select(packed(docs, docs.columns), docs[source].alias("_source"), draw(docs[doc_id], seed).alias("_draw"))
    both = given.join(per, F.col("_source").eqNullSafe(F.col("_of")), "left")
    copies = (F.floor("_rate") + F.when(F.col("_draw") < F.col("_rate") - F.floor("_rate"), 1).otherwise(0)).cast("int")
    again = both.withColumn("_copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))
    return again.select(*unpacked(docs.columns))
