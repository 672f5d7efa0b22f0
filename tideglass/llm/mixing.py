"""Mixing sources to target weights: hash-random keys, range buckets of them within each source, prefix sums of word counts
over the buckets, and a cut at each source's exact budget, with whole epochs before the cut where the budget exceeds the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.llm.common import checkpoint, word_count

WEIGHTS = (3, 1, 2)
#: A bucket is the first three hex digits of a row's key: 4096 ranges of each source.
BUCKET_DIGITS = 3
#: Most sources (a row of about 100 bytes each) whose plan is broadcast; beyond it, the join is shuffled.
BROADCAST_SOURCES = 250_000


def targets(sources: DataFrame, share: float, cap: int, weights: tuple[int, ...]) -> DataFrame:
    """sources: _source, source_size, one row each. Adds _weight and target.

    Weights follow the sources' code-point order, null last. Water-filling in closed form: sources are sorted by how soon
    they reach cap * size; the first that stays below its cap fixes what one unit of weight gets. Windows run over one row
    per source, never over documents.
    """
    every = Window.orderBy(F.col("_source").asc_nulls_last())
    df = sources.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    df = df.withColumn("_cap", F.col("source_size") * cap)
    by = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("_source").asc_nulls_last())
    df = df.withColumns({"_k": F.row_number().over(by), "_total": F.sum("source_size").over(Window.partitionBy()), "_capped": F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_cap"), "_left": F.sum("_weight").over(by.rowsBetween(0, Window.unboundedFollowing))})
    rate = (F.lit(float(share)) * F.col("_total") - F.col("_capped")) / F.col("_left")
    fits = F.when(rate * F.col("_weight") <= F.col("_cap"), F.struct(F.col("_k").alias("k"), rate.alias("rate")))
    df = df.withColumn("_first", F.min(fits).over(Window.partitionBy()))
    return df.withColumn("target", F.when(F.col("_first.k").isNull() | (F.col("_k") < F.col("_first.k")), F.col("_cap").cast("double")).otherwise(F.col("_first.rate") * F.col("_weight"))).select("_source", "source_size", "target")


def mix(df: DataFrame, share: float = 1.5, cap: int = 2, weights: tuple[int, ...] = WEIGHTS, seed: int = 42, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None) -> DataFrame:
    """_row (a struct of df's columns, whatever they are called), _size, _source_size, _target (of the row's source) and _taken
    (words the mix takes, repeats counted).

    Sources share `share` times all words by weight; no target exceeds cap times its source. _taken of a source sums to its
    target, rounded; a source whose target is e times its size and some more takes every row e times, and the rows first in
    key order once more; the row at the cut gives only the words that are left. Null sources are one source, the last; null texts have no
    words; null ids have a key of their own; repeated rows are taken in the order of their ids and sizes, equal ones interchangeably. An empty
    table gives no rows.
    """
    size = word_count(F.col("text")) if size is None else size
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    src = F.struct(F.col(source_col).isNull().alias("none"), F.coalesce(F.col(source_col), F.lit("")).alias("name"))
    bucket = F.substring(key, 1, BUCKET_DIGITS)
    sums = checkpoint(df.select(size.alias("_size"), src.alias("_src"), bucket.alias("_bucket")).groupBy("_src", "_bucket").agg(F.sum("_size").alias("_words")))
    sources = sums.groupBy("_src").agg(F.sum("_words").alias("source_size")).withColumn("_source", F.when(~F.col("_src.none"), F.col("_src.name"))).drop("_src")
    plan = targets(sources, share, cap, weights).withColumn("_budget", F.floor(F.col("target") + 0.5)).withColumn("_epochs", F.when(F.col("source_size") > 0, F.expr("_budget div source_size")).otherwise(F.lit(0)))
    plan = plan.select(F.struct(F.col("_source").isNull().alias("none"), F.coalesce("_source", F.lit("")).alias("name")).alias("_src"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "_epochs", (F.col("_budget") - F.col("_epochs") * F.col("source_size")).alias("_rest"))
    # A source's rest ends in one bucket: buckets before it are taken whole, later ones not.
    before = F.sum("_words").over(Window.partitionBy("_src").orderBy("_bucket")) - F.col("_words")
    cuts = sums.withColumn("_before", before).join(plan.select("_src", "_rest"), "_src").filter((F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_words") >= F.col("_rest"))).select("_src", F.col("_bucket").alias("_cut"), "_before")
    plan = checkpoint(plan.join(cuts, "_src", "left"))
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    # Words are counted after a row is known to lie in the cut's bucket or outside it, so each row's are counted once; the bucket alone is sorted.
    wide = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), F.col(id_col).alias("_id"), size.alias("_size"), key.alias("_key"), src.alias("_src"), bucket.alias("_bucket"))
    joined = wide.join(plan, "_src")
    at_cut = F.coalesce(F.col("_bucket") == F.col("_cut"), F.lit(False))
    whole = joined.filter(~at_cut).withColumn("_more", F.when(F.col("_bucket") < F.col("_cut"), F.col("_size")).otherwise(F.lit(0)).cast("long"))
    order = Window.partitionBy("_src", "_bucket").orderBy("_key", "_id", "_size")
    at = F.col("_before") + F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    cut = joined.filter(at_cut).withColumn("_more", F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_rest") - at)).cast("long"))
    out = whole.unionByName(cut).withColumn("_taken", (F.col("_epochs") * F.col("_size") + F.col("_more")).cast("long"))
    return out.select("_row", "_size", "_source_size", "_target", "_taken")


def mixed_rows(df: DataFrame, **options) -> DataFrame:
    """The mix as rows of df: each row as often as its words are taken in whole. The row at a source's cut is taken once more if at
    least half of it fits, so that texts stay whole and a source misses its target by half a document at most. Rows without words cost
    nothing and stay once."""
    taken = mix(df, **options)
    times = F.when(F.col("_size") == 0, F.lit(1)).otherwise(F.floor((2 * F.col("_taken") + F.col("_size")) / (2 * F.col("_size"))))
    return taken.withColumn("_times", times.cast("int")).filter("_times > 0").select("_row", F.explode(F.expr("sequence(1, _times)"))).select("_row.*")
