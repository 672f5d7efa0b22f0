"""Scalar functions: hashes and shards, isolation-forest constants, detector bounds, run identities."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: Euler's constant to the digits that results depend on.
GAMMA = 0.5772156649


def java_hash(c: Column) -> Column:
    """The signed 32-bit string hash h = 31 * h + unit over UTF-16 units (characters outside the basic plane are not split into units)."""
    units = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    h = F.aggregate(units, F.lit(0).cast("long"), lambda a, x: (a * 31 + x).bitwiseAND(F.lit(4294967295)))
    return F.when(h >= 2147483648, h - 4294967296).otherwise(h).cast("int")


def shard_of(id_: Column, n: int) -> Column:
    """Shard 0..n-1 of a row: the remainder of the id's hash, without its sign."""
    return F.abs(java_hash(id_) % n).cast("int")


def average_path_length(n: Column) -> Column:
    """Mean path length of an unsuccessful search in a tree of n rows; 0 up to one row."""
    x = n.cast("double")
    return F.when(n <= 1, F.lit(0.0)).otherwise(2.0 * (F.ln(x - 1.0) + GAMMA) - 2.0 * (x - 1.0) / x)


def path_constant(n: float) -> float:
    return 0.0 if n <= 1 else 2.0 * (math.log(n - 1.0) + GAMMA) - 2.0 * (n - 1.0) / n


def batch_id(shard: Column, round_: Column) -> Column:
    return F.shiftleft(shard.cast("long"), 32).bitwiseOR(round_.cast("long"))


def batch_round(batch: Column) -> Column:
    return batch.bitwiseAND(F.lit(4294967295))


def ks_confirm_threshold(p: float) -> float:
    """ca of the two-sample Kolmogorov-Smirnov test at p-value p."""
    return math.sqrt(-0.5 * math.log(p))


def ks_threshold(p: float, w: int) -> float:
    return ks_confirm_threshold(p) * math.sqrt(2.0 / w)


def hoeffding_bound(n: Column, confidence: float) -> Column:
    return F.sqrt(F.lit(math.log(1.0 / confidence)) / (F.lit(2.0) * n))


def ewma_bound(lam: float, confidence: float) -> float:
    return math.sqrt(lam * math.log(1.0 / confidence) / (2.0 * (2.0 - lam)))


def deviation_signal(x: Column, reference: Column, scale: Column) -> Column:
    """Two-sided deviation from the reference in units of scale, at most 1."""
    return F.least(F.abs(x - reference) / scale, F.lit(1.0))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) fixed by the parts: 32 bits of md5 over their `|`-joined text."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


EXP_ID = r"^(.+?)_([^_]+)_([^_]+)_p(\d+)_r(\d+)(?:_(.*))?$"


def parse_exp_id(c: Column) -> Column:
    """struct(dataset, config, algo, parallelism, run, extra) of `{dataset}_{config}_{algo}_p{N}_r{run}[_k-v...]`; nulls where it does not
    match."""
    got = lambda i: F.nullif(F.regexp_extract(c, EXP_ID, i), F.lit(""))
    return F.struct(got(1).alias("dataset"), got(2).alias("config"), got(3).alias("algo"), got(4).cast("int").alias("parallelism"), got(5).cast("int").alias("run"), F.coalesce(got(6), F.lit("")).alias("extra"))


def parse_extra(c: Column) -> Column:
    """Map of `k=v;k2=v2`."""
    return F.str_to_map(c, F.lit(";"), F.lit("="))
