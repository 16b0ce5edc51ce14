"""Token-id files in patched frame-of-reference blocks.

A shard holds the ids of consecutive documents (ascending doc_id).  Its bytes, little-endian:

    magic b"PFR1", u32 block size, u64 documents, u64 ids, u64 blocks
    per document   i64 doc_id (null: -2**63), u64 ids
    per block      u64 start of the block, from the first block's start
    per block      u32 minimum, u8 width, u16 exceptions, u16 spare,
                   block size * width bits (low bit first),
                   u16 position of each exception, u32 value above the minimum of each exception

A block subtracts its minimum and packs at the width that ``PERCENTILE`` of its values need;
the others are exceptions (packed as 0).  The last block of a shard is padded with its
minimum.  The index of block starts gives random access: ``read_ids(shard, lo, hi)`` decodes only
the blocks it touches.

Shards are written as the binary cells of Parquet files in the shared folder: Spark's committed
writers are what reaches any store and survives a lost executor.  Columns beside the payload
place a shard: ``part`` (range of doc_ids), ``base`` (ids before it in its part), ``n_ids``.

Null texts are empty (one end id); empty tables give no shards; equal doc_ids stay neighbours, in
text order; a null doc_id comes first; extra columns are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmf.llm.common import shuffle_partitions, stored, table, text_bytes
from gridmf.llm.tokens import default_path, encoder, with_end
from gridmf.session import scratch_path

BLOCK = 512
PERCENTILE = 0.95
END_ID = 2
SHARD_IDS = 1 << 20
PART_BYTES = 16 << 20
GROUPS = 1024
MAGIC = b"PFR1"
HEAD = struct.Struct("<4sIQQQ")
NO_ID = -(1 << 63)
SHARD_SCHEMA = "part int, base long, n_docs long, n_ids long, payload binary"


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit lengths of unsigned values below 2**32."""
    return np.frexp(x.astype(np.float64))[1]


def encode_shard(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, block: int = BLOCK,
                 percentile: float = PERCENTILE) -> bytes:
    ids = np.asarray(ids, np.uint32)
    n_blocks = -(-len(ids) // block)
    pad = n_blocks * block - len(ids)
    if pad:
        ids = np.concatenate([ids, np.full(pad, ids[(n_blocks - 1) * block:].min(), np.uint32)])
    grid = ids.reshape(n_blocks, block)
    low = grid.min(axis=1) if n_blocks else np.zeros(0, np.uint32)
    delta = grid - low[:, None]
    rank = min(block - 1, int(np.ceil(percentile * block)) - 1)
    width = _bits(np.partition(delta, rank, axis=1)[:, rank]) if n_blocks else np.zeros(0, int)
    bodies: list[bytes] = [b""] * n_blocks
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        d = delta[rows]
        over = d >= np.uint64(1 << int(w))
        kept = np.where(over, np.uint32(0), d)
        bits = np.unpackbits(kept.astype("<u4").view(np.uint8).reshape(len(rows), block, 4), axis=2, bitorder="little")
        packed = np.packbits(bits[:, :, :w].reshape(len(rows), -1), axis=1, bitorder="little")
        n_over = over.sum(axis=1)
        for j, r in enumerate(rows.tolist()):
            tail = b""
            if n_over[j]:
                pos = np.flatnonzero(over[j])
                tail = pos.astype("<u2").tobytes() + d[j][pos].astype("<u4").tobytes()
            bodies[r] = struct.pack("<IBHH", int(low[r]), int(w), int(n_over[j]), 0) + packed[j].tobytes() + tail
    starts = np.cumsum([0] + [len(b) for b in bodies])[:-1].astype("<u8")
    table_ = np.empty((len(doc_ids), 2), "<i8")
    table_[:, 0], table_[:, 1] = doc_ids, counts
    n_ids = int(np.sum(counts)) if len(counts) else 0
    return b"".join([HEAD.pack(MAGIC, block, len(doc_ids), n_ids, n_blocks), table_.tobytes(), starts.tobytes(), *bodies])


class Shard:
    """A shard's header and index; ids are decoded block by block."""

    def __init__(self, payload: bytes):
        magic, self.block, n_docs, self.n_ids, self.n_blocks = HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEAD.size
        docs = np.frombuffer(payload, "<i8", 2 * n_docs, at).reshape(n_docs, 2)
        self.doc_ids, self.counts = docs[:, 0], docs[:, 1]
        at += 16 * n_docs
        self.starts = np.frombuffer(payload, "<u8", self.n_blocks, at)
        self.first = at + 8 * self.n_blocks
        self.payload = payload

    def blocks(self, lo: int, hi: int) -> np.ndarray:
        """Ids of blocks lo .. hi - 1, decoded a width at a time."""
        out = np.zeros((hi - lo, self.block), np.uint32)
        raw = np.frombuffer(self.payload, np.uint8)
        at = (self.starts[lo:hi] + np.uint64(self.first)).astype(np.int64)
        if hi == lo:
            return out.reshape(-1)
        heads = raw[at[:, None] + np.arange(9)]
        low = heads[:, :4].copy().view("<u4")[:, 0]
        width = heads[:, 4].astype(int)
        n_over = heads[:, 5:7].copy().view("<u2")[:, 0].astype(int)
        size = self.block * width // 8 + (self.block * width % 8 > 0)
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            if w:
                packed = raw[at[rows][:, None] + 9 + np.arange(size[rows[0]])]
                bits = np.unpackbits(packed, axis=1, count=self.block * w, bitorder="little").reshape(len(rows), self.block, w)
                wide = np.zeros((len(rows), self.block, 32), np.uint8)
                wide[:, :, :w] = bits
                out[rows] = np.packbits(wide, axis=2, bitorder="little").view("<u4")[:, :, 0]
        for r in np.flatnonzero(n_over).tolist():
            p = int(at[r] + 9 + size[r])
            pos = np.frombuffer(self.payload, "<u2", n_over[r], p)
            out[r, pos] = np.frombuffer(self.payload, "<u4", n_over[r], p + 2 * n_over[r])
        return (out + low[:, None]).reshape(-1)


def read_ids(shard: Shard, lo: int, hi: int) -> np.ndarray:
    """Ids lo .. hi - 1 of a shard."""
    hi = min(hi, shard.n_ids)
    if hi <= lo:
        return np.zeros(0, np.uint32)
    a, b = lo // shard.block, -(-hi // shard.block)
    return shard.blocks(a, b)[lo - a * shard.block:hi - a * shard.block]


def write_token_files(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = END_ID) -> None:
    """Encode whole texts and write shards in ascending doc_id order."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = max(shuffle_partitions(docs.sparkSession), text_bytes(d) // PART_BYTES + 1)

    def each(batches):
        enc, part, base = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n_held = 0

        def flush():
            nonlocal held, n_held, base
            doc_ids, counts, ids = (np.concatenate(x) for x in zip(*held))
            rows = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([base]), pa.array([len(doc_ids)]), pa.array([len(ids)]),
                 pa.array([encode_shard(doc_ids, counts, ids)], pa.binary())],
                names=["part", "base", "n_docs", "n_ids", "payload"])
            base, held, n_held = base + len(ids), [], 0
            return rows

        for batch in batches:
            doc_ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for lo, ids, at in enc.column(batch.column("text")):
                ids, at = with_end(ids, at, end_id)
                held.append((doc_ids[lo:lo + len(at) - 1], np.diff(at), ids))
                n_held += len(ids)
                if n_held >= SHARD_IDS:
                    yield flush()
        if held:
            yield flush()

    (d.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text").mapInArrow(each, SHARD_SCHEMA)
     .write.option("compression", "uncompressed").parquet(out))


def part_starts(shards: DataFrame, groups: int = GROUPS) -> DataFrame:
    """(part, part_start): the ids in all parts before each part, by sums within groups of parts and over the groups."""
    last = shards.agg(F.max("part")).first()[0]
    size = -(-((last or 0) + 1) // groups)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("g", F.floor(F.col("part") / size).cast("int"))
    of_group = {r.g: r.n for r in totals.groupBy("g").agg(F.sum("n").alias("n")).collect()}  # at most ``groups`` rows
    starts, total = [], 0
    for g in range(max(of_group, default=0) + 1):
        starts.append(total)
        total += of_group.get(g, 0)
    within = F.sum("n").over(Window.partitionBy("g").orderBy("part")) - F.col("n")
    return totals.select("part", (within + F.get(F.lit(starts).cast("array<bigint>"), F.col("g"))).alias("part_start"))


def read_token_files(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, decoded from the shards; ids little-endian unsigned 32-bit."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    before = stored(part_starts(shards), "token-parts")

    def each(batches):
        for batch in batches:
            for start, payload in zip(batch.column("start").to_pylist(), batch.column("payload")):
                shard = Shard(payload.as_py())
                ids = read_ids(shard, 0, shard.n_ids).astype("<u4")
                offs = np.zeros(len(shard.counts) + 1, np.int64)
                np.cumsum(shard.counts, out=offs[1:])
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(shard.counts), [
                    None, pa.py_buffer((offs * 4).tobytes()), pa.py_buffer(ids.tobytes())])
                doc_ids = pa.array(shard.doc_ids, mask=shard.doc_ids == NO_ID)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, pa.array(offs[:-1] + start), pa.array(shard.counts), data.cast(pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"])

    # a written table: its size decides whether it is broadcast
    placed = shards.join(before, "part").select((F.col("part_start") + F.col("base")).alias("start"), "payload")
    return placed.mapInArrow(each, "doc_id long, start long, n_tokens long, ids binary")


def op10_token_file(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), default_path(), path)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
