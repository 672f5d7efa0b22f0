"""Token-id storage by plane shuffling.

A store is a Parquet folder with one row per chunk. A chunk holds whole documents; its ids, little-endian unsigned 32-bit, are cut into
blocks of BLOCK ids, each block is transposed into four byte planes (or 32 bit planes), and every plane is compressed with zstandard by
itself. The chunk's index: the ids before it in its part, the documents' ids and lengths, and each compressed plane's length (0: a plane
of zeros). Parts follow the order of document ids, chunks the order in their part. A file may hold several parts, in any order.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideglass.llm import tokens
from tideglass.llm.common import checkpoint, trimmed

BLOCK = 1 << 16
#: A chunk is closed once it has so many ids; a document is never divided.
CHUNK_IDS = 1 << 18
LEVEL = 3
#: Small ranges share a task and its files, as long as there are FEW tasks for each core or one for so many bytes of the input.
FEW, FILE_BYTES = 2, 8 << 20
SCHEMA = "part int, chunk int, first long, n_ids long, doc_ids array<long>, doc_sizes array<long>, planes_per_block int, plane_sizes array<int>, payload binary"


def split_planes(block: np.ndarray, bits: bool) -> list[bytes]:
    raw = block.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [raw[:, k].tobytes() for k in range(4)]
    return [np.packbits(p, bitorder="little").tobytes() for p in np.unpackbits(raw, axis=1, bitorder="little").T]


def join_planes(planes: list[bytes | None], n: int) -> np.ndarray:
    if len(planes) == 4:
        raw = np.zeros((n, 4), dtype=np.uint8)
        for k, p in enumerate(planes):
            if p is not None:
                raw[:, k] = np.frombuffer(p, dtype=np.uint8)
    else:
        bit = np.zeros((n, 32), dtype=np.uint8)
        for k, p in enumerate(planes):
            if p is not None:
                bit[:, k] = np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n, bitorder="little")
        raw = np.packbits(bit, axis=1, bitorder="little")
    return raw.view("<u4").reshape(-1)


def encode_chunk(ids: np.ndarray, bits: bool = False, block: int = BLOCK) -> tuple[bytes, list[int]]:
    """(payload, plane sizes)."""
    z, out, sizes = zstandard.ZstdCompressor(level=LEVEL), [], []
    for a in range(0, len(ids), block):
        for plane in split_planes(ids[a : a + block], bits):
            data = z.compress(plane) if plane.count(0) < len(plane) else b""
            out.append(data)
            sizes.append(len(data))
    return b"".join(out), sizes


def decode_chunk(payload: bytes, sizes: list[int], n_ids: int, planes_per_block: int, block: int = BLOCK) -> np.ndarray:
    z, at, parts = zstandard.ZstdDecompressor(), 0, [np.zeros(0, dtype="<u4")]
    for b, a in enumerate(range(0, n_ids, block)):
        planes = []
        for n in sizes[b * planes_per_block : (b + 1) * planes_per_block]:
            planes.append(z.decompress(payload[at : at + n]) if n else None)
            at += n
        parts.append(join_planes(planes, min(block, n_ids - a)))
    return np.concatenate(parts)


def write_tokens(df: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, bits: bool = False, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes a store of df's texts, ascending by id (null ids first; equal ids by their texts' checksum), each text's ids followed by
    end_id. Null texts have the end id alone; an empty table makes an empty store. Rows are dealt by ranges of (id, checksum,
    partition that they came in), so a repeated id is spread, and so are equal rows, and every range is a part: sorted by itself and encoded in order, one chunk in memory at a time. A lost task is run
    again; the folder appears as a whole.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokens.bytes_encoder(tokenizer_path, spec.value), tokens.as_bytes([end_id])
        part, chunk, first, docs, held, n_held = None, 0, 0, [], [], 0

        def row():
            payload, sizes = encode_chunk(np.frombuffer(b"".join(held), dtype="<u4"), bits)
            values = [part, chunk, first, n_held, [d for d, _ in docs], [n for _, n in docs], 32 if bits else 4, sizes, payload]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, ARROW)], names=[f.name for f in ARROW_SCHEMA])

        for batch in tokens.by_bytes(batches, "text"):
            for p, d, t in zip(batch.column("part").to_pylist(), batch.column("id").to_pylist(), batch.column("text")):
                if p != part:
                    if docs:
                        yield row()
                    part, chunk, first, docs, held, n_held = p, 0, 0, [], [], 0
                data = encode(t.as_py()) + end
                docs.append((d, len(data) // 4))
                held.append(data)
                n_held += len(data) // 4
                if n_held >= CHUNK_IDS:
                    yield row()
                    chunk, first, docs, held, n_held = chunk + 1, first + n_held, [], [], 0
        if docs:
            yield row()

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    key = F.crc32(F.col("text").cast("binary"))
    ranged = rows.withColumn("_from", F.spark_partition_id()).repartitionByRange("id", key, "_from").sortWithinPartitions("id", key)
    parts = ranged.select(F.spark_partition_id().alias("part"), "id", "text")
    in_few_tasks(parts, df).mapInArrow(trimmed(run), SCHEMA).write.parquet(path)


def in_few_tasks(df: DataFrame, source: DataFrame) -> DataFrame:
    """df with small partitions put together, unmoved, by the size that Spark estimates for source; a large one's stay as they are.

    Each task writes files of its own, and a local file system without Hadoop's native library starts a process for every file and folder.
    """
    spark = df.sparkSession
    size = source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    n = max(FEW * spark.sparkContext.defaultParallelism, -(-size // FILE_BYTES))
    return df.coalesce(n) if n < int(spark.conf.get("spark.sql.shuffle.partitions")) else df


ARROW_SCHEMA = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_sizes", pa.list_(pa.int64())), ("planes_per_block", pa.int32()), ("plane_sizes", pa.list_(pa.int32())), ("payload", pa.binary())])
ARROW = [f.type for f in ARROW_SCHEMA]


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False, id_col: str = "doc_id") -> DataFrame:
    """Decodes a store: id_col, start (ids of all documents before it), n_tokens, ids_crc32, and ids (array<long>) if asked for."""
    store = spark.read.schema(SCHEMA).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                ids = decode_chunk(r["payload"], r["plane_sizes"], r["n_ids"], r["planes_per_block"])
                ends = np.cumsum(r["doc_sizes"])
                parts = [ids[e - n : e] for e, n in zip(ends.tolist(), r["doc_sizes"])]
                out = [pa.array([r["part"]] * len(parts), pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array((r["first"] + ends - r["doc_sizes"]).tolist(), pa.int64()), pa.array(r["doc_sizes"], pa.int64()), pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())]
                if with_ids:
                    out.append(pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(out, ["part", "doc_id", "at", "n_tokens", "ids_crc32", "ids"][: len(out)])

    more = ", ids array<long>" if with_ids else ""
    docs = store.select("part", "first", "n_ids", "doc_ids", "doc_sizes", "planes_per_block", "plane_sizes", "payload").mapInArrow(trimmed(run), f"part int, doc_id long, at long, n_tokens long, ids_crc32 long{more}")
    # One row per part, and there are as many parts as the writer had ranges.
    sums = store.groupBy("part").agg(F.sum("n_ids").alias("n"))
    offsets = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    return docs.join(offsets, "part").select(F.col("doc_id").alias(id_col), (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    checkpoint(spark.range(0))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored_tokens(df: DataFrame, tokenizer_path: str, end_id: int = 2, bits: bool = False) -> DataFrame:
    """Writes a store of df in the shared folder, reads it back and deletes it; the decoded rows, checkpointed."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, "token-store")
    try:
        write_tokens(df, path, tokenizer_path, end_id, bits)
        return checkpoint(in_few_tasks(read_tokens(spark, path), df))
    finally:
        delete(spark, path)
