"""Helpers shared by the text operators: shared-folder tables, Arrow text slices, word hashes.

Words are the runs of bytes other than space and ``\\x09-\\x0D``; as these are
ASCII, splitting UTF-8 bytes and splitting characters give the same words.
Operators that compare texts hash words and lines by XXH3 (64 bits) of their bytes, once for
each distinct one of a batch; features and counts of models, and sequences of hashes, take
polynomial hashes finished with a bit mixer, computed for a whole batch with NumPy.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one NumPy step works on (a longer text is a slice of its own).
SLICE_BYTES = 1 << 21
#: The same where a byte of text takes very many bytes of arrays.
FEW_BYTES = 1 << 19

_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_BASE_INV = pow(_BASE, -1, 1 << 64)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, else the context's checkpoint folder; a new temporary one only where
    neither is set and all of Spark is this machine. What the operators write there stays, for lazy results read it:
    clear it when they are done."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = getattr(spark, "_aerocast_llm_folder", None) or tempfile.mkdtemp(prefix="aerocast-")
        spark._aerocast_llm_folder = folder
    return folder.rstrip("/")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Removes a query's shuffle files when it ends; what ``written`` ran is read from its table from then on.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, survives lost executors. The shuffle files
    behind it go as soon as the table stands."""
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark)}/llm-{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: What operators keep in a Python worker for their next task: dicts that may be emptied at any time.
HELD: list[dict] = []


def let_go() -> None:
    """Frees what tasks of other operators have left in this Python worker, so that the stages of a pipeline don't add
    up in one executor; nothing is done where nothing is left."""
    if not any(HELD):
        return
    for held in HELD:
        held.clear()
    gc.collect()
    give_back()


def give_back() -> None:
    """Hands what NumPy and Arrow have freed, and keep for later, back to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(ctypes.CDLL(None), "malloc_trim"):
        ctypes.CDLL(None).malloc_trim(0)


def spare(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that also gives memory back when it ends: an executor keeps more Python workers than it runs
    tasks at a time, and what each one got for its largest step would add up while they wait."""
    def task(batches: Iterator) -> Iterator:
        let_go()
        try:
            yield from run(batches)
        finally:
            give_back()
    return task


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A new folder under the shared one, removed at the end: for tables that nothing lazy reads afterwards."""
    folder = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def large_binaries(batch) -> pa.LargeBinaryArray:
    """A text column as large binary without nulls (null: empty)."""
    col = batch.combine_chunks() if isinstance(batch, pa.ChunkedArray) else batch
    return col.fill_null("").cast(pa.large_string()).cast(pa.large_binary())


def slices(texts: pa.LargeBinaryArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, row offsets into the bytes) of consecutive rows."""
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective bit mixer on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; kept while not much longer than needed."""
    p = _powers.get(name)
    if p is None or len(p) <= n:
        p = np.full(max(n + 1, 1 << 16), base, dtype=np.uint64)
        p[0] = 1
        np.multiply.accumulate(p, out=p)
        if len(p) <= 2 * SLICE_BYTES:
            _powers[name] = p
    return p


def text_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of bytes; a polynomial modulo 2**64 would collide on some regular texts."""
    size = ends - starts
    where = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    solid = data[np.repeat(starts - where[:-1], size) + np.arange(where[-1])]
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(where), pa.py_buffer(solid)]).dictionary_encode()
    distinct = np.fromiter(map(xxhash.xxh3_64_intdigest, found.dictionary.to_pylist()), np.uint64, len(found.dictionary))
    return distinct[np.asarray(found.indices)]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of the spans [start, end) of a sequence of unsigned values."""
    n = len(values)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.multiply(values.astype(np.uint64) + np.uint64(1), _power("base", _BASE, n)[:n], out=sums[1:])
    np.cumsum(sums, out=sums)
    h = (sums[ends] - sums[starts]) * _power("inverse", _BASE_INV, n)[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * _MUL))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, index of the first word of each row, with the total at the end)."""
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    first[inner] = solid[inner]
    starts = np.flatnonzero(first)
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edge = inner[inner > 0] - 1
    last[edge] = solid[edge]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def window_hashes(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of each n consecutive values (len - n + 1 of them; row edges are the caller's)."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    src = mix(words + np.uint64(salt)) if salt else words
    if n <= 8:
        h = np.full(len(src) - n + 1, n + 1, dtype=np.uint64)
        for j in range(n):
            h = mix(h * _MUL + src[j:len(src) - n + 1 + j])
        return h
    starts = np.arange(len(src) - n + 1)
    return span_hashes(src, starts, starts + n)


def windows_in_rows(first: np.ndarray, n: int) -> np.ndarray:
    """Starts of the windows of n words that lie within one row; first as from word_spans."""
    total = int(first[-1])
    if total < n:
        return np.zeros(0, dtype=np.int64)
    end = np.repeat(first[1:], np.diff(first))
    at = np.arange(total)
    return at[at + n <= end]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def total_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a text column over all rows (one number to the driver, used to size partitions)."""
    return int(df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0)


def clean_documents(docs: DataFrame) -> DataFrame:
    """doc_id and text; rows whose doc_id is null take no part in operators that compare documents."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
