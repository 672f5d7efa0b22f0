"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits are cut into partitions of bits that go together (correlated bits share a partition, so that what skew there is
sits in few partitions). If two fingerprints differ in at most `radius` bits, then for any thresholds t_1..t_m with
sum(t_i) = radius - m + 1 some partition i differs in at most t_i bits (t_i = -1: the partition is never probed). Thresholds come from
dynamic programming over the candidate counts that a sample predicts. Every distinct fingerprint is indexed under its own partition values and probes
all values within t_i; what meets is verified by its full distance. A meeting place is bounded: large ones are cut into blocks and every
pair of blocks is a task of its own, and a task returns a spanning forest of its links, never all pairs.

Sets of shingles whose Jaccard similarity counts need a radius of 15 and more, at which 64 bits keep little apart: partitions have 4 or 5 bits
then, and work grows with the square of the rows. So the pigeonhole brings together all that are within SURE bits, and for those further
apart the partitioned bits are those of a longer signature. Its bits go together by eights (a place of the signature agrees or differs as a whole), a partition is a run of places that must agree, and the widths of the partitions come
from dynamic programming over the candidate counts that a sample predicts, for a stated recall. What meets is verified on the sets.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.common import SPACE_WORD, TO_LOWER, checkpoint, trimmed

BITS = 64
#: Fingerprints that are sampled to estimate correlations and candidate counts; they choose a plan, never a result.
SAMPLE = 2000
#: Rows of a meeting place beyond which it is cut into blocks of about this size.
BLOCK = 16384
#: Cost of emitting one probe row, in verified pairs.
PROBE_COST = 2000
#: Radius within which the pigeonhole brings all fingerprints of sets together, whatever their number; beyond it, up to the radius that is asked for, signatures do.
SURE = 4
#: Share of the pairs at the least similarity asked for that some partition of the signature must bring together.
RECALL = 0.98
#: Most large meeting places (about 24 bytes each) that are broadcast; beyond it, the join that finds them is shuffled.
BROADCAST_PLACES = 2_000_000
#: Most keys of dropped rows that are broadcast; beyond it, the join that drops them is shuffled.
BROADCAST_KEYS = 2_000_000
#: Signature length for similarity, in bytes; the estimate's standard error at .8 is sqrt(.8 * .2 / 128) = .035.
PERMUTATIONS = 128
#: Signatures only choose candidates: a pair may agree in so much less than the similarity that is asked for (four standard errors).
SLACK = 0.15
#: Rows and shingles of a group of candidates beyond which it is cut into blocks of about this size.
VERIFY_ROWS, VERIFY_SHINGLES = 4096, 1 << 20

_WORD = re.compile(SPACE_WORD)


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 (seed 42) of the n-word shingles of a text with A-Z lower-cased; fewer words: of the whole sequence; none: nothing."""
    words = _WORD.findall((text or "").translate(TO_LOWER))
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([digest(" ".join(words).encode("utf-8", "surrogatepass"), 42)], dtype=np.uint64)
    parts = [w.encode("utf-8", "surrogatepass") for w in words]
    joined, at = b" ".join(parts), [0]
    for p in parts:
        at.append(at[-1] + len(p) + 1)
    return np.fromiter((digest(joined[a : b - 1], 42) for a, b in zip(at, at[n:])), dtype=np.uint64, count=len(words) - n + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if more than half of the hashes have it; bits are counted for 65,536 hashes at a time."""
    ones = np.zeros(BITS, dtype=np.int64)
    for a in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[a : a + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


_A = np.random.default_rng(11).integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(hashes: np.ndarray) -> bytes:
    """8 bits of the least multiple of the hashes under each of PERMUTATIONS odd factors: two texts agree in a share of places that
    estimates the Jaccard similarity of their shingle sets (and one of 256 of the other places). Zeros for a text without shingles."""
    if not len(hashes):
        return bytes(PERMUTATIONS)
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[a : a + 4096, None] * _A[None, :]).min(axis=0), out=least)
    return (least >> np.uint64(20)).astype(np.uint8).tobytes()


def fingerprints(df: DataFrame, shingle: int, sets: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _key (hash of id and text), _fp (the 64 bits as a signed long) of every row. Null and word-less texts have fingerprint 0. With
    `sets`, also what depends on the set of shingles alone: _set (a 64-bit hash of it), _size, _near (its fingerprint) and _sig."""
    names = ["_id", "_key", "_fp", *(["_set", "_size", "_near", "_sig"] if sets else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
        for batch in batches:
            fps, hashes, sizes, near, sigs = [], [], [], [], []
            for t in batch.column("text"):
                h = shingle_hashes(t.as_py(), shingle)
                fps.append(fingerprint(h))
                if sets:
                    u = np.unique(h)
                    hashes.append(xxhash.xxh64_intdigest(u.tobytes(), 7))
                    sizes.append(len(u))
                    near.append(fps[-1] if len(u) == len(h) else fingerprint(u))
                    sigs.append(signature(u))
            out = [batch.column("_id"), batch.column("_key"), signed(fps)]
            yield pa.RecordBatch.from_arrays(out + ([signed(hashes), pa.array(sizes, pa.int64()), signed(near), pa.array(sigs, pa.binary())] if sets else []), names)

    return df.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(id_col, text_col).alias("_key"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), "_id long, _key long, _fp long" + ", _set long, _size long, _near long, _sig binary" * sets)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


@dataclass(frozen=True)
class Plan:
    """parts: bit positions of each partition; thresholds: theirs, -1 for one that is not probed."""

    parts: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]


def group_bits(sample: np.ndarray, m: int) -> tuple[tuple[int, ...], ...]:
    """m groups of nearly equal size; each starts from the free bit that is most correlated with others and takes the bits most
    correlated with it."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    bits = bits - bits.mean(axis=0) if len(bits) else bits
    scale = np.sqrt((bits**2).sum(axis=0)) + 1e-9
    corr = np.abs(bits.T @ bits / scale[:, None] / scale[None, :])
    np.fill_diagonal(corr, 0)
    free, groups = list(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        own = [max(free, key=lambda b: (corr[b, free].max(), -b))]
        free.remove(own[0])
        while len(own) < size:
            own.append(max(free, key=lambda b: (corr[b, own].sum(), -b)))
            free.remove(own[-1])
        groups.append(tuple(sorted(own)))
    return tuple(groups)


def allocate(costs: list[list[float]], total: int) -> tuple[float, tuple[int, ...]]:
    """Least sum of costs[i][t_i + 1] over t_i >= -1 with sum(t_i) = total, and these t_i: dynamic programming over partitions."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for row in costs:
        nxt: dict[int, tuple[float, tuple[int, ...]]] = {}
        for s, (c, ts) in best.items():
            for k, x in enumerate(row):
                if s + k - 1 not in nxt or c + x < nxt[s + k - 1][0]:
                    nxt[s + k - 1] = (c + x, (*ts, k - 1))
        best = nxt
    return best.get(total, (math.inf, ()))


def _cost(n: int, rows: int, share: float) -> float:
    """Of a partition under which each of n nodes has so many rows and a share of all pairs meets: a row is copied for each block of its place."""
    return n * n / 2 * share + n * rows * PROBE_COST * max(1.0, n * share / BLOCK)


def plan(sample: np.ndarray, n: int, radius: int) -> Plan:
    """The cheapest partitioning and thresholds for n distinct fingerprints: each candidate pair costs 1, each probe row PROBE_COST, as often as
    it is copied. Candidate counts are estimated from the sample's pairs."""
    sample = sample[:SAMPLE]
    k = min(len(sample), 1000)
    pairs = (sample[:k, None] ^ sample[None, :k])[np.triu_indices(k, 1)] if k > 1 else np.zeros(0, dtype=np.uint64)
    best = None
    for m in range(1, min(BITS, radius + 1) + 1):
        parts = group_bits(sample, m)
        total, costs = radius - m + 1, []
        for p in parts:
            d = np.bitwise_count(pairs & np.uint64(sum(1 << b for b in p)))
            row = [0.0]
            for t in range(0, min(max(total, 0) + m, len(p)) + 1):
                ball = sum(math.comb(len(p), j) for j in range(t + 1))
                # A sample sees no rare event: at least what independent even bits would give.
                share = max(float((d <= t).mean()) if len(d) else 0.0, ball / 2.0 ** len(p))
                row.append(_cost(n, ball, share))
                if ball > 1e7:
                    break
            costs.append(row)
        cost, ts = allocate(costs, total)
        if best is None or cost < best[0]:
            best = (cost, Plan(parts, ts))
    return best[1]


def widths(sample: np.ndarray, n: int, similarity: float, recall: float = RECALL) -> tuple[int, ...]:
    """How many places of the signature each partition takes, at the least cost for n nodes so that two sets of this similarity agree in all
    places of some partition with a chance of at least `recall`: dynamic programming over (chance, places used). sample: signatures, a row each."""
    k = min(len(sample), 500)
    agree = np.concatenate([(sample[i] == sample[i + 1 : k]).mean(axis=1) for i in range(k - 1)]) if k > 1 else np.zeros(0)
    same = similarity + (1 - similarity) / 256
    unit = 0.02  # of -log(chance to miss)
    goal = math.ceil(-math.log(1 - recall) / unit)
    options = []
    for w in range(1, 9):
        share = max(float((agree**w).mean()) if len(agree) else 0.0, 256.0**-w)
        options.append((w, int(-math.log(1 - same**w) / unit), _cost(n, 1, share)))
    best: dict[tuple[int, int], tuple[float, tuple[int, ...]]] = {(0, 0): (0.0, ())}
    found = None
    while best:
        nxt: dict[tuple[int, int], tuple[float, tuple[int, ...]]] = {}
        for (gain, used), (cost, ws) in best.items():
            for w, g, c in options:
                if used + w > PERMUTATIONS or g < 1 or (ws and w > ws[-1]) or (found and cost + c >= found[0]):
                    continue
                to = (min(goal, gain + g), used + w)
                if to not in nxt or cost + c < nxt[to][0]:
                    nxt[to] = (cost + c, (*ws, w))
                if to[0] == goal:
                    found = (cost + c, (*ws, w))
        best = {k: v for k, v in nxt.items() if k[0] < goal}
    return found[1] if found else (1,) * PERMUTATIONS


def _values(fps: np.ndarray, part: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(len(fps), dtype=np.int64)
    for k, b in enumerate(part):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def _probes(nodes: DataFrame, p: Plan) -> DataFrame:
    """_part, _key, _probe (0: indexed under its own value; 1: a neighbouring value), _id, _fp."""
    offsets = [[sum(1 << b for b in c) for j in range(t + 1) for c in itertools.combinations(range(len(part)), j)] for part, t in zip(p.parts, p.thresholds)]
    names = ["_part", "_key", "_probe", "_id", "_fp"]

    def run(batches):
        for batch in batches:
            fps = batch.column("_fp").to_numpy().view(np.uint64)
            for i, (part, flips) in enumerate(zip(p.parts, offsets)):
                own = _values(fps, part) if flips else None
                for f in flips:
                    columns = [pa.array(np.full(len(fps), i, dtype=np.int32)), pa.array(own ^ f), pa.array(np.full(len(fps), int(f != 0), dtype=np.int8))]
                    yield pa.RecordBatch.from_arrays(columns + [batch.column(c) for c in names[3:]], names)

    return nodes.select(*names[3:]).mapInArrow(trimmed(run), "_part int, _key long, _probe byte, _id long, _fp long")


def _signature_rows(nodes: DataFrame, ws: tuple[int, ...], sig: bool = True) -> DataFrame:
    """_part, _key (the bytes of the partition's places), _probe (0), _id, _fp and, with sig, _sig."""
    names = ["_part", "_key", "_probe", "_id", "_fp", "_sig"][: 5 + sig]

    def run(batches):
        for batch in batches:
            n, at = batch.num_rows, 0
            sigs = np.frombuffer(b"".join(batch.column("_sig").to_pylist()), dtype=np.uint8).reshape(n, PERMUTATIONS)
            for i, w in enumerate(ws):
                key = np.zeros((n, 8), dtype=np.uint8)
                key[:, :w] = sigs[:, at : at + w]
                at += w
                columns = [pa.array(np.full(n, i, dtype=np.int32)), pa.array(key.view("<i8").reshape(n)), pa.array(np.zeros(n, dtype=np.int8))]
                yield pa.RecordBatch.from_arrays(columns + [batch.column(c) for c in names[3:]], names)

    return nodes.select("_id", "_fp", "_sig").mapInArrow(trimmed(run), "_part int, _key long, _probe byte, _id long, _fp long" + ", _sig binary" * sig)


def _forest(ids: np.ndarray, fps: np.ndarray, sigs: np.ndarray | None, left: np.ndarray, right: np.ndarray, radius: int, similar: float) -> list[tuple[int, int]]:
    """Links between rows where one is in `left` and the other in `right` (Boolean; a row may be in both): all of them while they
    are fewer than four a row, else a spanning forest. It takes time in the square of a place's bounded rows, memory in proportion."""
    n, edges = len(ids), []
    step = max(1, (1 << 20) // n)
    for a in range(0, n, step):
        b = min(n, a + step)
        near = _distances(fps[a:b, None], fps[None, a:]) <= radius
        near &= (left[a:b, None] & right[None, a:]) | (right[a:b, None] & left[None, a:])
        i, j = np.nonzero(np.triu(near, 1))
        i, j = i + a, j + a
        if sigs is not None:
            same = np.zeros(len(i), dtype=bool)
            for k in range(0, len(i), 1 << 15):
                x = slice(k, k + (1 << 15))
                same[x] = (sigs[i[x]] == sigs[j[x]]).mean(axis=1) >= similar
            i, j = i[same], j[same]
        edges += zip(ids[i].tolist(), ids[j].tolist())
        if len(edges) > 4 * n:
            break
    else:
        return edges
    open_, edges = np.ones(n, dtype=bool), []
    for s in range(n):
        if not open_[s]:
            continue
        open_[s] = False
        queue = [s]
        while queue:
            u = queue.pop()
            rest = np.flatnonzero(open_ & ((right & left[u]) | (left & right[u])))
            near = rest[_distances(fps[rest], fps[u]) <= radius]
            if sigs is not None and len(near):
                near = near[(sigs[near] == sigs[u]).mean(axis=1) >= similar]
            open_[near] = False
            queue += near.tolist()
            edges += [(int(ids[u]), int(ids[v])) for v in near.tolist()]
    return edges


def _stars(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same components by one edge for each node, to the least node that it reaches."""
    least: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := least.setdefault(x, x)) != x:
            least[x] = least[up]
            x = up
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        if a != b:
            least[max(a, b)] = min(a, b)
    return [(r, x) for x in list(least) if (r := root(x)) != x]


def links(nodes: DataFrame, radius: int, min_similarity: float | None = None) -> DataFrame:
    """(u, v): links between nodes (_id, distinct _fp or distinct (_fp, _sig)) enough to connect all that are within radius. Given
    min_similarity, the pigeonhole connects all that are within SURE bits; of those further apart, nodes that agree in all places of a partition of
    the signature meet, and those link that are within radius and whose signatures agree in a share of places of at least min_similarity less SLACK."""
    sig = min_similarity is not None
    n = nodes.count()
    sample = nodes.select("_fp", *(["_sig"] if sig else [])).orderBy(F.xxhash64("_fp"), "_fp").limit(SAMPLE).collect()
    sure = min(radius, SURE) if sig else radius
    p = plan(np.array([r["_fp"] for r in sample], dtype=np.int64).view(np.uint64), n, sure)
    rows = _probes(nodes, p)
    found = _met(rows, rows, n * sum(math.comb(len(part), j) for part, t in zip(p.parts, p.thresholds) for j in range(t + 1)), sure)
    if sig:
        ws = widths(np.frombuffer(b"".join(r["_sig"] for r in sample), dtype=np.uint8).reshape(-1, PERMUTATIONS), n, min_similarity)
        found = found.union(_met(_signature_rows(nodes, ws), _signature_rows(nodes, ws, False), n * len(ws), radius, max(0.0, min_similarity - SLACK))).distinct()
    return found


def _met(rows: DataFrame, places: DataFrame, n_rows: int, radius: int, similar: float | None = None) -> DataFrame:
    """(u, v): links within radius of the rows that meet in a place (_part, _key), given `similar` of those whose signatures agree in that share of
    places. places: the rows without what is not needed to count them."""
    sig = similar is not None
    # Meeting places that are too large: at most (rows / BLOCK) of them.
    large = checkpoint(places.groupBy("_part", "_key").count().filter(F.col("count") > BLOCK).select("_part", "_key", F.ceil(F.col("count") / BLOCK).cast("int").alias("_blocks")))
    large = F.broadcast(large) if n_rows <= BROADCAST_PLACES * BLOCK else large
    rows = rows.join(large, ["_part", "_key"], "left").withColumns({"_blocks": F.coalesce("_blocks", F.lit(1)), "_block": F.pmod(F.xxhash64("_id"), F.coalesce("_blocks", F.lit(1))).cast("int")})
    rows = rows.select("*", F.explode(F.expr("sequence(0, _blocks - 1)")).alias("_other")).withColumns({"_a": F.least("_block", "_other"), "_b": F.greatest("_block", "_other")}).drop("_blocks", "_other")
    place = ["_part", "_key", "_a", "_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def solve(t: pa.Table) -> list[tuple[int, int]]:
            c = {x: t.column(x).to_numpy() for x in ("_probe", "_block", "_a", "_b", "_id", "_fp")}
            s = None
            if sig:
                s = np.frombuffer(b"".join(t.column("_sig").to_pylist()), dtype=np.uint8).reshape(-1, PERMUTATIONS)
            index = c["_probe"] == 0
            keys = [t.column(x).to_numpy() for x in place]
            cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            edges = []
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), t.num_rows]):
                if b - a < 2:
                    continue
                x = slice(a, b)
                # An indexed row meets every row of the place; in a task of two blocks, of the other block.
                left, right = index[x], np.ones(b - a, dtype=bool)
                if c["_a"][a] != c["_b"][a]:
                    first = c["_block"][x] == c["_a"][a]
                    edges += _forest(c["_id"][x], c["_fp"][x].view(np.uint64), None if s is None else s[x], left & first, right & ~first, radius, similar)
                    left, right = left & ~first, right & first
                edges += _forest(c["_id"][x], c["_fp"][x].view(np.uint64), None if s is None else s[x], left, right, radius, similar)
            return edges

        def out(edges):
            e = np.array(_stars(edges) if sig else edges, dtype=np.int64).reshape(-1, 2)
            e = e[e[:, 0] != e[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(e.min(axis=1, initial=2**63 - 1)), pa.array(e.max(axis=1, initial=-(2**63)))], ["u", "v"])

        for batch in batches:  # sorted by place: all but the last place of what has come is whole
            held.append(pa.Table.from_batches([batch]))
            t = pa.concat_tables(held)
            last = [t.column(x).to_numpy() for x in place]
            start = np.flatnonzero(np.any([k != k[-1] for k in last], axis=0))
            k = int(start[-1]) + 1 if len(start) else 0
            if k:
                yield out(solve(t.slice(0, k)))
            held = [t.slice(k)]
        if held:
            yield out(solve(pa.concat_tables(held)))

    return rows.repartition(*place).sortWithinPartitions(*place).mapInArrow(trimmed(run), "u long, v long").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): the least node that each node of an edge reaches; alternating large-star and small-star, which keep no more
    than one row per edge, until nothing changes. Lineage is cut every round."""
    e = checkpoint(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct())
    state = None
    for _ in range(rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v")
        large = large.filter("u < v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        e = checkpoint(small.select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).filter("u < v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = e.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return stars.union(e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def similar_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Positions (i, j) of links enough to connect all sets (distinct hashes) whose Jaccard similarity is at least `similarity`."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    _, code = np.unique(flat, return_inverse=True)
    order = np.argsort(code, kind="stable")
    holders, starts = owner[order], np.concatenate([[0], np.cumsum(np.bincount(code))])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    open_, n_open, edges = np.ones(n, dtype=bool), n, []
    for s in range(n):
        if not open_[s]:
            continue
        open_[s], n_open, queue = False, n_open - 1, [s]
        while queue and n_open:
            u = queue.pop()
            own = code[begin[u] : begin[u + 1]]
            common = np.zeros(n, dtype=np.int64)
            for a in range(0, len(own), 1024):
                k = own[a : a + 1024]
                lengths = starts[k + 1] - starts[k]
                at = np.repeat(starts[k] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
                common += np.bincount(holders[at], minlength=n)
            found = np.flatnonzero(open_ & (common > 0) & (common >= similarity * (sizes + sizes[u] - common)))
            open_[found] = False
            n_open -= len(found)
            queue += found.tolist()
            edges += [(u, int(v)) for v in found]
    return edges


def verified(df: DataFrame, nodes: DataFrame, loose: DataFrame, shingle: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(u, v): links between nodes (_id, _row: _key of a row that has its text, _size) of one component of `loose` (node, component) enough to
    connect all whose shingle sets have a Jaccard similarity of at least `similarity`, counted on the sets themselves.

    The texts of nodes in components are fetched, one for each node. A large component is cut into blocks, and each pair of blocks is a task.
    """
    groups = loose.join(nodes.select(F.col("_id").alias("node"), "_row", "_size"), "node")
    cut = groups.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / VERIFY_ROWS, F.sum("_size") / VERIFY_SHINGLES)).cast("int").alias("_blocks"))
    wanted = checkpoint(groups.join(cut, "component").select("node", "component", "_row", "_blocks"))
    keys = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted
    texts = df.select(F.xxhash64(id_col, text_col).alias("_row"), F.col(text_col).alias("_text")).join(keys, "_row")
    blocks = texts.withColumn("_block", F.pmod(F.xxhash64("node"), F.greatest("_blocks", F.lit(1))).cast("int"))
    # With more than one block the pairs of different blocks hold all pairs of rows.
    blocks = blocks.withColumn("_other", F.explode(F.expr("filter(sequence(0, greatest(_blocks, 1) - 1), x -> _blocks <= 1 or x <> _block)")))
    rows = blocks.select("component", F.least("_block", "_other").alias("_a"), F.greatest("_block", "_other").alias("_b"), "node", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sets = None, {}

        def out():
            ids = list(sets)
            e = np.array([(ids[i], ids[j]) for i, j in similar_links(list(sets.values()), similarity)], dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(e.min(axis=1, initial=2**63 - 1)), pa.array(e.max(axis=1, initial=-(2**63)))], ["u", "v"])

        for batch in batches:  # sorted by place
            for *at, node, text in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
                if at != place:
                    if len(sets) > 1:
                        yield out()
                    place, sets = at, {}
                if node not in sets:  # rows equal in id and text
                    sets[node] = np.unique(shingle_hashes(text.as_py(), shingle))
        if len(sets) > 1:
            yield out()

    place = ["component", "_a", "_b"]
    return rows.repartition(*place).sortWithinPartitions(*place).mapInArrow(trimmed(run), "u long, v long").distinct()


def near_duplicates(df: DataFrame, shingle: int = 4, radius: int = 4, min_similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col, fingerprint (16 hex digits), component_id (least id reachable over links) for every row.

    Rows link if their fingerprints differ in at most `radius` bits. Given min_similarity, candidates are all rows whose fingerprints (of the sets of
    shingles) differ in at most SURE bits, by the pigeonhole, and rows that partitions of signatures of the sets bring together and that
    fingerprints, within `radius`, and whole signatures, held against a lower bar, leave. Of these rows link whose sets have at least that Jaccard
    similarity; a pair at exactly that similarity is a candidate with a chance of at least about RECALL.
    Equal fingerprints (or sets) are one node from the start, so copies never make pairs. Null and word-less texts have fingerprint 0 and
    link like others (given min_similarity, with each other); repeated ids are told apart by their fingerprints; a null id is in the
    component of its text, and never names it unless all its ids are null. An empty table gives no rows; other columns are ignored.
    """
    named = _named(df, shingle, radius, min_similarity, id_col, text_col)
    return named.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def _named(df: DataFrame, shingle: int, radius: int, min_similarity: float | None, id_col: str, text_col: str) -> DataFrame:
    """_id, _key (hash of id and text), _fp, component_id and _c (the component's own number) of every row."""
    sets = min_similarity is not None
    key = "_set" if sets else "_fp"
    rows = checkpoint(fingerprints(df, shingle, sets, id_col, text_col))
    # A fingerprint, or the 64-bit hash of a set, is its node's own number (two of n sets meet with a chance of n * n / 2**65).
    of_set = [F.first("_near").alias("_fp"), F.first("_sig").alias("_sig"), F.first("_size").alias("_size"), F.min("_key").alias("_row")]
    nodes = checkpoint(rows.groupBy(F.col(key).alias("_id")).agg(F.min("_id").alias("_least"), *(of_set if sets else [F.first("_fp").alias("_fp")])))
    found = components(links(nodes, radius, min_similarity))
    if sets:
        found = components(verified(df, nodes, found, shingle, min_similarity, id_col, text_col))
    by_node = nodes.join(found, nodes._id == found.node, "left").select(F.col("_id").alias(key), "_least", F.coalesce("component", "_id").alias("_c"))
    names = by_node.groupBy("_c").agg(F.min("_least").alias("component_id"))
    named = by_node.join(names, "_c").select(key, "component_id", "_c")
    return rows.join(named, key).select("_id", "_key", "_fp", "component_id", "_c")


def one_of_each(df: DataFrame, shingle: int = 5, radius: int = 18, min_similarity: float | None = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each component: that with the least id (null last). Of rows equal in id and text one stays. Rows
    are told by a 64-bit hash of id and text: two of n distinct rows have one hash with a chance of n * n / 2**65."""
    rows = checkpoint(_named(df, shingle, radius, min_similarity, id_col, text_col).select("_id", "_key", "_c"))
    first = rows.groupBy("_c").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_key"))["_key"].alias("_first"))
    lost = checkpoint(rows.join(first, "_c").filter("_key != _first").select("_key").distinct())
    lost_keys = F.broadcast(lost) if lost.count() <= BROADCAST_KEYS else lost
    kept = df.join(lost_keys, F.xxhash64(df[id_col], df[text_col]) == lost_keys["_key"], "left_anti")
    if rows.groupBy("_key").count().filter("count > 1").join(lost, "_key", "left_anti").limit(1).count():
        kept = kept.dropDuplicates([id_col, text_col])
    return kept
