"""Two rounds of lookups between chunks of documents and buckets of hashes.

Operators that compare every word position of a corpus would shuffle one row a word. Here
a chunk (some MB of text, by ranges of doc_id) sends each bucket of the hash space its
distinct keys as one packed array, and gets one packed answer back, in the same order. A
key that a third of all documents hold so arrives once a chunk, not once a document, and
no group grows with a hot key. All of it is one Spark plan: the texts are dealt to chunks
once, and both rounds and the result read that exchange.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerocast.llm.common import clean_documents, total_bytes

#: Bytes of text in a chunk, and keys of one round in a bucket, on average.
CHUNK_BYTES, BUCKET_KEYS = 4 << 20, 1 << 20

CELL = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("n", pa.int64()), ("data", pa.binary())])
CELL_DDL = "bucket int, chunk int, n long, data binary"
REPLY_DDL = "to int, round int, bucket int, answer binary"


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """(chunk, doc_id, text) of the rows with a doc_id, and the bits of the bucket number. Chunks are ranges of
    doc_id: all ids of a chunk are below those of the next."""
    docs = clean_documents(docs).filter("doc_id IS NOT NULL")
    size = total_bytes(docs)
    n = max(1, -(-size // chunk_bytes))
    near = docs.stat.approxQuantile("doc_id", [k / n for k in range(1, n)], 1 / (4 * n)) if n > 1 else []
    splits = [-float("inf"), *(sorted(set(near)) or [0.0]), float("inf")]
    # exact in doubles up to 2**53; larger ids that round alike fall into the same chunk
    at = Bucketizer(splits=splits, inputCol="_id", outputCol="_chunk").transform(docs.withColumn("_id", F.col("doc_id").cast("double")))
    bits = max(0, (size // 6 // BUCKET_KEYS).bit_length())
    return at.select(F.col("_chunk").cast("int").alias("chunk"), "doc_id", "text"), bits


def cells(chunk: int, bucket: np.ndarray, arrays: list[np.ndarray], flags: list[np.ndarray]) -> pa.Table:
    """One row a bucket: the arrays' bytes one after the other, then the flags as bits; bucket is ascending."""
    if not len(bucket):
        return CELL.empty_table()
    which, begin = np.unique(bucket, return_index=True)
    end = np.append(begin[1:], len(bucket))
    data = [b"".join([*(x[a:b].tobytes() for x in arrays), *(np.packbits(x[a:b]).tobytes() for x in flags)]) for a, b in zip(begin, end, strict=True)]
    return pa.table([which.astype(np.int32), np.full(len(which), chunk, np.int32), end - begin, pa.array(data, pa.binary())], schema=CELL)


def unpacked(n: int, data: bytes, types: list, flags: int) -> list[np.ndarray]:
    """The arrays and flags of a cell."""
    out, at = [], 0
    for kind in types:
        out.append(np.frombuffer(data, dtype=kind, count=n, offset=at))
        at += n * np.dtype(kind).itemsize
    for _ in range(flags):
        width = (n + 7) // 8
        out.append(np.unpackbits(np.frombuffer(data, np.uint8, width, at), count=n).astype(bool))
        at += width
    return out


def columns_of(table: pa.Table, types: list, flags: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(chunk of each cell, first entry of each cell with the total, concatenated arrays) of a bucket's cells, by chunk."""
    table = table.sort_by("chunk")
    sizes = np.asarray(table.column("n"))
    parts = [unpacked(int(n), d.as_py(), types, flags) for n, d in zip(sizes, table.column("data"), strict=True)]
    return np.asarray(table.column("chunk")), np.concatenate(([0], np.cumsum(sizes))), [np.concatenate(x) for x in zip(*parts, strict=True)]


def replies(turn: int, table: pa.Table, chunk: np.ndarray, at: np.ndarray, answer: Callable[[slice], bytes]) -> pa.Table:
    """A row for each cell of a bucket."""
    bucket = table.column("bucket")[0].as_py()
    data = [answer(slice(a, b)) for a, b in zip(at[:-1], at[1:], strict=True)]
    return pa.table([pa.array(chunk, pa.int32()), pa.array([turn] * len(data), pa.int32()), pa.array([bucket] * len(data), pa.int32()),
                     pa.array(data, pa.binary())], names=["to", "round", "bucket", "answer"])


def answers(table: pa.Table, turn: int) -> list[bytes]:
    """A chunk's answers of one round, by bucket."""
    mine = table.filter(pa.array(np.asarray(table.column("round")) == turn)).sort_by("bucket")
    return [d.as_py() for d in mine.column("answer")]


def bits_of(parts: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Bits of consecutive cells with their sizes."""
    out = [np.unpackbits(np.frombuffer(p, np.uint8), count=int(n)).astype(bool) for p, n in zip(parts, sizes, strict=True)]
    return np.concatenate(out) if out else np.zeros(0, bool)


def two_rounds(chunks: DataFrame, first: Callable, sum_first: Callable, second: Callable, sum_second: Callable,
               result: Callable, schema: str) -> DataFrame:
    """``first(chunk table) -> cells``, ``sum_first(bucket table) -> replies``, ``second(chunk table, replies) -> cells``,
    ``sum_second`` and ``result(chunk table, replies of both rounds)``; the chunk tables have chunk, doc_id, text."""
    def side(k: int):
        return chunks.select(*[F.col(c).alias(f"{c}_{k}") for c in ("chunk", "doc_id", "text")]).groupBy(f"chunk_{k}")

    def named(table: pa.Table) -> pa.Table:
        return table.rename_columns(["chunk", "doc_id", "text"])

    def renamed(df: DataFrame, k: int) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{c}_{k}") for c in df.columns])

    def plain(table: pa.Table) -> pa.Table:
        return table.rename_columns([c[:-2] for c in table.column_names])

    one = side(1).applyInArrow(lambda t: first(named(t)), CELL_DDL)
    back = one.groupBy("bucket").applyInArrow(sum_first, REPLY_DDL)
    two = (side(2).cogroup(renamed(back, 2).groupBy("to_2"))
           .applyInArrow(lambda t, r: second(named(t), plain(r)), CELL_DDL))
    more = two.groupBy("bucket").applyInArrow(sum_second, REPLY_DDL)
    both = renamed(back, 3).union(renamed(more, 3))
    return side(3).cogroup(both.groupBy("to_3")).applyInArrow(lambda t, r: result(named(t), plain(r)), schema)
