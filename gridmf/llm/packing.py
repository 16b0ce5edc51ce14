"""Packing by power-of-two decomposition.

A document of n ids is cut into ``n // max_len`` pieces of ``max_len`` ids and one piece for each
binary digit of the rest, longest first.  Every piece is a power of two long and is a
sequence of its own: sequences of one length form a bucket (``length``) that batches without any
padding, and no sequence crosses documents.  ``sequence_id`` is unique; it is Spark's
``monotonically_increasing_id`` over the scan, so a task that is run again gives the same ids.

One pass, no shuffle.  Null text: empty, only the end id.  Repeated rows and equal or null
doc_ids are packed each for itself; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmf.llm.common import small_batches, table
from gridmf.llm.tokens import default_path, encoder, with_end

MAX_LEN = 2048
END_ID = 1
SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary"


def cut(counts: np.ndarray, max_len: int = MAX_LEN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document index, start, length) of the pieces of documents with ``counts`` ids; ``max_len`` a power of two."""
    full, rest = counts // max_len, counts % max_len
    digits = [1 << k for k in range(max_len.bit_length() - 2, -1, -1)]
    doc = [np.repeat(np.arange(len(counts)), full)]
    size = [np.full(int(full.sum()), max_len, np.int64)]
    first = np.cumsum(full) - full
    start = [(np.arange(int(full.sum())) - np.repeat(first, full)) * max_len]
    for d in digits:
        has = np.flatnonzero(rest & d)
        doc.append(has)
        size.append(np.full(len(has), d, np.int64))
        start.append(full[has] * max_len + (rest[has] & ~np.int64(2 * d - 1)))
    doc, start, size = np.concatenate(doc), np.concatenate(start), np.concatenate(size)
    order = np.lexsort((start, doc))
    return doc[order], start[order], size[order]


def pack(docs: DataFrame, path: str, max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids): ids little-endian unsigned 32-bit."""
    small_batches(docs.sparkSession)

    def each(batches):
        enc = encoder(path)
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for lo, ids, at in enc.column(batch.column("text")):
                ids, at = with_end(ids, at, end_id)
                counts = np.diff(at)
                doc, start, size = cut(counts, max_len)
                # pieces tile the documents in order, so the ids buffer is already the binary column's data
                offs = np.append(at[doc] + start, at[-1]) * 4
                data = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(doc), [None, pa.py_buffer(offs.astype(np.int64).tobytes()),
                                                  pa.py_buffer(ids.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(lo, len(counts)).take(pa.array(doc)), pa.array(start), pa.array(size),
                     pa.array(counts[doc]), data.cast(pa.binary())],
                    names=["doc_id", "start", "length", "doc_tokens", "ids"])

    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(each, SCHEMA)
    return pieces.select("doc_id", "start", "length", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"),
                         F.lit(0).cast("long").alias("offset"), "ids")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return packed_rows(table(spark, sf_dir, "documents"))


def packed_rows(docs: DataFrame) -> DataFrame:
    """The contract's rows, with the pieces' ids as their crc32."""
    return pack(docs, default_path()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
