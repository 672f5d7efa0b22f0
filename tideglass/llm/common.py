"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import functools
import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters that are none of these white-space characters.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = str.maketrans(UPPER, LOWER)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone, as the Python side does with TO_LOWER."""
    return F.translate(c, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of white-space separated words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and cuts its lineage.

    The cluster names the folder in spark.checkpoint.dir; a temporary one serves only where it is unset and all is on one machine (tests).
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder on a local master, and an error on any other."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or tempfile.mkdtemp(prefix="checkpoint-")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(taken, *names: str) -> list[str]:
    """names, each with underscores before it until no column of `taken` is called so (Spark ignores case)."""
    used, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in used:
            n = "_" + n
        used.add(n.lower())
        out.append(n)
    return out


def trimmed(run: Callable) -> Callable:
    """A mapInArrow function that gives memory back to the system when its task ends: workers are kept for later stages."""

    @functools.wraps(run)
    def then_trim(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return then_trim
