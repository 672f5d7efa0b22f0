"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns `vnodes` points of a 64-bit ring; a row belongs to the first point clockwise from its hash. Every shard has a
capacity. Points are visited clockwise; a point keeps its own rows while its shard has room, and what is over continues
clockwise, first come first placed, to the next points whose shards have room. Only the counts of the ring's arcs reach the
driver (n_shards * vnodes numbers, whatever the input's size); rows then find their place from their rank in their arc.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideglass.llm.common import checkpoint

VNODES = 256
#: Copies of one row that are made by one task.
COPIES = 10_000


def ring(n_shards: int, vnodes: int = VNODES) -> tuple[np.ndarray, np.ndarray]:
    """Positions (signed 64-bit, ascending) and the shard of each."""
    points = sorted((xxhash.xxh64_intdigest(f"{s}:{v}", 7) - 2**63, s) for s in range(n_shards) for v in range(vnodes))
    return np.array([p for p, _ in points], dtype=np.int64), np.array([s for _, s in points], dtype=np.int64)


def capacities(natural: list[int], epsilon: float | None) -> list[int]:
    """epsilon None: as even as can be (at most one apart, the larger ones to the shards that most rows hash to); else
    ceil((1 + epsilon) * mean) for each."""
    total, n = sum(natural), len(natural)
    if epsilon is not None:
        return [-(-int(total * (1 + epsilon) * 2**20) // (n * 2**20)) + 1] * n
    order = sorted(range(n), key=lambda s: (-natural[s], s))
    more = set(order[: total % n])
    return [total // n + (s in more) for s in range(n)]


def flows(counts: np.ndarray, shard_of: np.ndarray, n_shards: int, epsilon: float | None) -> list[tuple[int, int, int, int]]:
    """Pieces (arc, first rank, rows, shard) in the order in which a shard takes them."""
    natural = np.bincount(shard_of, weights=counts, minlength=n_shards).astype(np.int64).tolist()
    room, pieces, over = capacities(natural, epsilon), [], []
    for a, s in enumerate(shard_of.tolist()):
        n = int(counts[a])
        own = min(n, room[s])
        room[s] -= own
        if own:
            pieces.append((a, 0, own, s))
        over.append([a, own, n - own])
    carried: deque = deque()
    for turn in range(2):
        for a, s in enumerate(shard_of.tolist()):
            if turn == 0 and over[a][2]:
                carried.append(over[a])
            while carried and room[s]:
                head = carried[0]
                n = min(head[2], room[s])
                pieces.append((head[0], head[1], n, s))
                room[s] -= n
                head[1], head[2] = head[1] + n, head[2] - n
                if not head[2]:
                    carried.popleft()
    return pieces


def ring_shards(df: DataFrame, n_shards: int, epsilon: float | None = None, vnodes: int = VNODES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col, size (UTF-8 bytes of the text, null: none, plus 16), text_crc32, shard, slot.

    epsilon None balances row counts to at most one apart; a positive epsilon lets a shard hold up to (1 + epsilon) times the
    mean, which moves fewer rows. Slots are gapless from 0 in each shard. A row's place depends on the set of rows alone: ranks
    follow (hash, id, size, checksum), and rows that are equal in all of these are interchangeable: they are counted before they meet in an
    arc, and made again after they have their places. Null ids and texts hash like any other value; an empty table gives no rows; other columns
    are ignored.
    """
    at, shard_of = ring(n_shards, vnodes)

    @F.pandas_udf("int")
    def arc(h: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(at, h.to_numpy(np.int64)) % len(at)).astype(np.int32))

    rows = df.select(F.col(id_col).alias("_id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"))
    rows = rows.groupBy("_id", "size", "text_crc32").agg(F.count("*").alias("_n"))
    rows = checkpoint(rows.withColumn("_h", F.xxhash64("_id", "text_crc32")).withColumn("_arc", arc("_h")))
    counts = np.zeros(len(at), dtype=np.int64)
    for a, n in rows.groupBy("_arc").agg(F.sum("_n")).collect():  # one number for each of the ring's arcs
        counts[a] = n
    pieces = flows(counts, shard_of, n_shards, epsilon)
    filled, starts = [0] * n_shards, []
    for a, first, n, s in pieces:
        starts.append((a, first, s, filled[s]))
        filled[s] += n
    starts.sort()
    # A piece's code orders pieces by arc and then by first rank; an arc may hold up to 2**40 rows.
    code = np.array([(a << 40) + first for a, first, _, _ in starts], dtype=np.int64)
    to = np.array([(s, slot - first) for _, first, s, slot in starts], dtype=np.int64).reshape(-1, 2)

    @F.pandas_udf("struct<shard int, slot long>")
    def place(arcs: pd.Series, rank: pd.Series) -> pd.DataFrame:
        k = np.searchsorted(code, (arcs.to_numpy(np.int64) << 40) + rank.to_numpy(np.int64), side="right") - 1
        return pd.DataFrame({"shard": to[k, 0].astype(np.int32), "slot": to[k, 1] + rank.to_numpy(np.int64)})

    order = Window.partitionBy("_arc").orderBy("_h", "_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("_rank", F.sum("_n").over(order) - F.col("_n"))
    blocks = ranked.filter(F.col("_n") > COPIES).select("*", F.explode(F.expr(f"sequence(0L, _n - 1, {COPIES}L)")).alias("_from")).select("_id", "size", "text_crc32", "_arc", (F.col("_rank") + F.col("_from")).alias("_rank"), F.least(F.lit(COPIES), F.col("_n") - F.col("_from")).alias("_n"))
    few = ranked.filter(F.col("_n") <= COPIES).select(*blocks.columns)
    copies = lambda df: df.select("*", F.explode(F.expr("sequence(0L, _n - 1)")).alias("_copy"))
    each = copies(few).unionByName(copies(blocks.repartition("_arc", "_rank")))
    placed = each.select("_id", "size", "text_crc32", place("_arc", F.col("_rank") + F.col("_copy")).alias("_to"))
    return placed.select(F.col("_id").alias(id_col), "size", "text_crc32", "_to.shard", "_to.slot")
