"""Reshaping and routing: features to rows, shards, balance, shuffles, renumbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.functions.scalar import shard_of


def split_features(df: DataFrame) -> DataFrame:
    """A row for each feature of each row: feature_id, value, seq; nothing for null or empty features."""
    return df.select("seq", F.posexplode("features").alias("feature_id", "value")).select("feature_id", "value", "seq")


def with_shard(df: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    return df.withColumn("shard", shard_of(F.col(id_col), n))


def by_shard(df: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    """Dealt to n partitions by shard."""
    return with_shard(df, n, id_col).repartition(n, "shard")


def by_feature(values: DataFrame, parallelism: int) -> DataFrame:
    return values.repartition(parallelism, "feature_id")


def to_all(control: DataFrame, n: int) -> DataFrame:
    """A copy of each control row for each shard; there are few control rows."""
    return control.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("shard"))


def balance(df: DataFrame, key: str = "shard") -> DataFrame:
    c = df.groupBy(key).agg(F.count("*").alias("n"))
    total = F.broadcast(c.agg(F.sum("n").alias("_all")))
    return c.crossJoin(total).select(key, "n", (F.col("n") / F.col("_all")).alias("share"))


def shuffled(df: DataFrame, seed: int, id_col: str = "id") -> DataFrame:
    """In an order that the seed and the ids alone fix; `shuffle_key` has it."""
    return df.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string")).cast("binary"))).orderBy("shuffle_key", id_col)


def dense_numbers(df: DataFrame, order: str, name: str, start: int = 1, block: Column | None = None) -> DataFrame:
    """df with name = the row's rank by `order` (a unique whole number) from `start`."""
    from tideglass.operators.running import running

    return running(df, [], order, {name: ("count", F.lit(1))}, block).withColumn(name, F.col(name) + (start - 1))


def last_of_each(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The last n rows of each group: of each block of `order` its last n first, so that no task sorts a whole group."""
    from pyspark.sql import Window

    blocks = df.withColumn("_block", F.floor(F.col(order) / (1 << 16)))
    some = blocks.withColumn("_r", F.row_number().over(Window.partitionBy(by, "_block").orderBy(F.desc(order)))).filter(F.col("_r") <= n)
    return some.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).filter(F.col("_r") <= n).drop("_r", "_block")
