"""Token-ID output as length-delimited binary records, and reading it back (operator 12).

``TokenRecords`` is a Spark data source (format ``token_records``) for sequences of token
ids. A data file holds one framed record per sequence, each with

    length    u64, of the payload      checksum  u32, masked CRC-32 of the 8 length bytes
    payload   flags u8 (1: id is null), id i64, ids   checksum  u32, masked CRC-32 of the payload

all little-endian; ids are u16 where the table says so (``width`` 2), else u32. Masking
(rotate by 15 bits, add a constant) keeps a checksum from being one of data that hold
checksums. The index file beside it has, for each record and for the end, the byte offset
and the number of ids before it, as two u64: a reader seeks to any record, or to a block
of records, without reading others. ``MANIFEST.json`` lists the files in the order of
their rows, with records and ids of each; it is put in place last, by renaming, so a
table is either whole or absent, and files of lost or repeated task attempts are not in it.

The writer needs rows whose partitions are ranges in file order, as ``write_records`` makes
them: (id, ids array<int>), or (id, text) with the vocabulary file (on the driver) and the
end id as options; texts are then encoded by the task that writes them. Files go to any folder that pyarrow opens (file, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from aerocast.llm.common import large_binaries, total_bytes
from aerocast.llm.units import AFTER, UnitCoder

FORMAT = "token_records"
MANIFEST = "MANIFEST.json"
#: Bytes of text for one data file; bytes of payload that a reader holds at once (a longer record alone).
FILE_BYTES, READ_BYTES = 32 << 20, 4 << 20
#: Distinct units that a worker remembers.
MEMO = 400_000

_HEAD, _CRC, _KEY = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<Bq")


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(path))


class Corrupt(ValueError):
    """A record whose lengths or checksums don't hold."""


def frame(key: int | None, ids: bytes) -> bytes:
    payload = _KEY.pack(key is None, key or 0) + ids
    length = struct.pack("<Q", len(payload))
    return b"".join([length, _CRC.pack(masked(length)), payload, _CRC.pack(masked(payload))])


def unframe(data: memoryview, at: int) -> tuple[memoryview, int]:
    """Payload of the record at ``at`` and the place after it; raises Corrupt."""
    if len(data) < at + _HEAD.size:
        raise Corrupt(f"record at {at}: cut off")
    length, check = _HEAD.unpack_from(data, at)
    if check != masked(bytes(data[at:at + 8])):
        raise Corrupt(f"record at {at}: checksum of the length")
    begin = at + _HEAD.size
    payload = data[begin:begin + length]
    if len(data) < begin + length + 4 or _CRC.unpack_from(data, begin + length)[0] != masked(payload):
        raise Corrupt(f"record at {at}: checksum of the payload")
    return payload, begin + length + 4


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str
    records: int
    ids: int
    bytes: int


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, width: int, vocabulary: bytes | None = None, end_id: int | None = None):
        self.path, self.width, self.vocabulary, self.end_id = path, width, vocabulary, end_id

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = filesystem(self.path)
        partition = TaskContext.get().partitionId()
        name = f"part-{partition:06d}-{uuid.uuid4().hex}"
        fs.create_dir(folder, recursive=True)
        records = total = size = 0
        with fs.open_output_stream(f"{folder}/{name}.rec") as out, fs.open_output_stream(f"{folder}/{name}.idx") as index:
            for batch in iterator:
                for keys, sequences in self._sequences(batch):
                    frames, places = [], np.empty((len(keys), 2), dtype="<u8")
                    for k, (key, ids) in enumerate(zip(keys, sequences, strict=True)):
                        frames.append(frame(key, ids))
                        places[k] = size, total
                        size += len(frames[-1])
                        total += len(ids) // self.width
                    out.write(b"".join(frames))
                    index.write(places.tobytes())
                    records += len(keys)
            index.write(np.array([size, total], dtype="<u8").tobytes())
        return Written(partition, name, records, total, size)

    def _sequences(self, batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
        keys, col = batch.column(0).to_pylist(), batch.column(1)
        if self.vocabulary is None:
            yield keys, [self._bytes(np.asarray(x.values)) for x in col]
            return
        for at, to, ids, ends in unit_coder(self.vocabulary).slices(large_binaries(col)):
            if self.end_id is not None:
                ids, ends = np.insert(ids, ends[1:], self.end_id), ends + np.arange(len(ends))
            data, places = self._bytes(ids), (ends * self.width).tolist()
            yield keys[at:to], [data[a:b] for a, b in zip(places[:-1], places[1:], strict=True)]

    def _bytes(self, ids: np.ndarray) -> bytes:
        if len(ids) and (int(ids.max()) >= 1 << 8 * self.width or int(ids.min()) < 0):
            raise ValueError(f"an id does not fit into {self.width} bytes")
        return ids.astype(f"<u{self.width}").tobytes()

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = filesystem(self.path)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        kept = {f"{m.name}.{x}" for m in parts for x in ("rec", "idx")}
        fs.create_dir(folder, recursive=True)
        manifest = {"width": self.width, "files": [[m.name, m.records, m.ids, m.bytes] for m in parts]}
        tmp = f"{folder}/{MANIFEST}.{uuid.uuid4().hex}"
        with fs.open_output_stream(tmp) as out:
            out.write(json.dumps(manifest).encode())
        fs.move(tmp, f"{folder}/{MANIFEST}")
        for info in fs.get_file_info(pafs.FileSelector(folder)):  # of other attempts, or overwritten
            if info.base_name.startswith("part-") and info.base_name not in kept:
                fs.delete_file(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = filesystem(self.path)
        for m in messages:
            for x in ("rec", "idx") if m is not None else ():
                if fs.get_file_info(f"{folder}/{m.name}.{x}").type != pafs.FileType.NotFound:
                    fs.delete_file(f"{folder}/{m.name}.{x}")


@dataclass
class Part(InputPartition):
    name: str
    records: int
    start: int  # ids of all files before
    width: int


class Reader(DataSourceReader):
    """One partition a file. Option ``ids``: ``array`` (array<int>) or ``binary`` (u32, little-endian); ``seed``: rows of a
    file, and files, in an order drawn by it (for training); ``start`` is always the place in file order."""

    def __init__(self, path: str, binary: bool, seed: int | None):
        self.path, self.binary, self.seed = path, binary, seed

    def manifest(self) -> dict:
        fs, folder = filesystem(self.path)
        with fs.open_input_stream(f"{folder}/{MANIFEST}") as f:
            return json.loads(f.read())

    def partitions(self) -> list[Part]:
        manifest, parts, start = self.manifest(), [], 0
        for name, records, ids, _ in manifest["files"]:
            parts.append(Part(name, records, start, manifest["width"]))
            start += ids
        if self.seed is not None:
            parts = [parts[k] for k in np.random.default_rng(self.seed).permutation(len(parts))]
        return parts

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(self.path)
        with fs.open_input_stream(f"{folder}/{part.name}.idx") as f:
            index = np.frombuffer(f.read(), dtype="<u8").reshape(-1, 2)
        if len(index) != part.records + 1:
            raise Corrupt(f"{part.name}: index of {len(index) - 1} records, {part.records} due")
        with fs.open_input_file(f"{folder}/{part.name}.rec") as f:
            for a, b in self._blocks(index, part):
                data = memoryview(f.read_at(int(index[b, 0] - index[a, 0]), int(index[a, 0])))
                order = range(a, b)
                if self.seed is not None:
                    order = a + np.random.default_rng([self.seed, zlib.crc32(part.name.encode()), a]).permutation(b - a)
                yield self._batch(data, index, order, int(index[a, 0]), part)

    def _blocks(self, index: np.ndarray, part: Part) -> list[tuple[int, int]]:
        out, at = [], 0
        while at < part.records:
            to = max(at + 1, int(np.searchsorted(index[:, 0], index[at, 0] + np.uint64(READ_BYTES), side="right")) - 1)
            out.append((at, to))
            at = to
        if self.seed is not None:
            out = [out[k] for k in np.random.default_rng([self.seed, part.start]).permutation(len(out))]
        return out

    def _batch(self, data: memoryview, index: np.ndarray, order, base: int, part: Part) -> pa.RecordBatch:
        keys, starts, arrays = [], [], []
        for k in order:
            payload, end = unframe(data, int(index[k, 0]) - base)
            if end != int(index[k + 1, 0]) - base:
                raise Corrupt(f"{part.name}: record {k} does not end where the next begins")
            null, key = _KEY.unpack_from(payload)
            ids = np.frombuffer(payload, dtype=f"<u{part.width}", offset=_KEY.size)
            if len(ids) != int(index[k + 1, 1] - index[k, 1]):
                raise Corrupt(f"{part.name}: record {k} has {len(ids)} ids")
            keys.append(None if null else key)
            starts.append(part.start + int(index[k, 1]))
            arrays.append(ids)
        sizes = np.fromiter(map(len, arrays), np.int64, len(arrays))
        flat = np.concatenate(arrays) if arrays else np.zeros(0, "<u2")
        if self.binary:
            col = pa.array([x.astype("<u4").tobytes() for x in arrays], pa.binary())
        else:
            col = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat.astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes), col], names=["id", "start", "n_tokens", "ids"])


class TokenRecords(DataSource):
    """Options: ``path``; on writing ``width`` (bytes of an id, 2 or 4), ``vocabulary`` and ``end_id``; on reading ``ids`` and ``seed``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        ids = T.BinaryType() if self.options.get("ids", "array") == "binary" else T.ArrayType(T.IntegerType())
        return T.StructType([T.StructField("id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()),
                             T.StructField("ids", ids)])

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        vocabulary, end_id = self.options.get("vocabulary"), self.options.get("end_id")
        if vocabulary is not None:
            with open(vocabulary, "rb") as f:
                vocabulary = f.read()
        return Writer(self.options["path"], int(self.options.get("width", 4)), vocabulary, None if end_id is None else int(end_id))

    def reader(self, schema: T.StructType) -> Reader:
        seed = self.options.get("seed")
        return Reader(self.options["path"], self.options.get("ids", "array") == "binary", None if seed is None else int(seed))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenRecords)


# ------------------------------------------------------------------ the tokenizer
_LOADED: dict[str, UnitCoder] = {}


def unit_coder(data: bytes) -> UnitCoder:
    """A coder over the tokenizers library for a byte-level vocabulary file, made once in each Python worker."""
    key = f"{len(data)}-{zlib.crc32(data)}"
    if key not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_str(data.decode())
        specials = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
        # a byte-level vocabulary writes each byte as one character
        size = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), dtype=np.int64)
        for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
            size[i] = len(specials[i].encode()) if i in specials else len(token)

        def encode(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            # Units that begin with a space can be joined, for cuts stay cuts. Others (begins of texts) go alone.
            joins = np.fromiter((len(u) > 1 and u[0] == 0x20 and AFTER[u[1]] for u in units), bool, len(units))
            inner, alone, found = list(compress(units, joins)), list(compress(units, ~joins)), []
            sizes = np.zeros(len(units), np.int64)
            ends = np.cumsum(np.fromiter(map(len, inner), np.int64, len(inner)))
            for at in range(0, len(inner), 2000):
                ids = np.array(tokenizer.encode(b"".join(inner[at:at + 2000]).decode(), add_special_tokens=False).ids, dtype="<u4")
                found.append(ids)
            joined = np.concatenate(found) if found else np.zeros(0, "<u4")
            last = np.searchsorted(np.cumsum(size[joined]), ends) + 1
            sizes[joins] = np.diff(last, prepend=0)
            singles = []
            for at in range(0, len(alone), 500):
                singles += [np.array(e.ids, dtype="<u4") for e in tokenizer.encode_batch([u.decode() for u in alone[at:at + 500]], add_special_tokens=False)]
            if not singles:
                return joined, sizes
            sizes[~joins] = list(map(len, singles))
            # back into the order of the units
            begin = np.zeros(len(units), np.int64)
            begin[joins] = last - sizes[joins]
            begin[~joins] = len(joined) + np.cumsum(sizes[~joins]) - sizes[~joins]
            flat, done = np.concatenate([joined, *singles]), np.cumsum(sizes)
            return flat[np.repeat(begin - (done - sizes), sizes) + np.arange(done[-1])], sizes

        _LOADED.clear()
        _LOADED[key] = UnitCoder(encode, "<u4", MEMO)
    return _LOADED[key]


def write_records(docs: DataFrame, path: str, vocabulary: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text",
                  file_bytes: int = FILE_BYTES) -> None:
    """Encodes whole texts with the tokenizers library, appends ``end_id``, and writes the sequences in ascending order of
    ``id_col`` (null ids first) in the format above.

    ``vocabulary``: a byte-level ``.json`` file on the driver, sent to the tasks; special strings inside texts are handled
    as the library does by default, no special tokens are added. Null and empty texts have the end id only. Rows that
    repeat an id are ordered by a hash of their text, then the text; columns besides the two named are ignored. Texts are
    dealt out by ranges of (id, hash of the text), so an id that a third of the rows hold is spread over many files.
    ids are written in two bytes where the vocabulary and the end id allow it.
    """
    spark = docs.sparkSession
    register(spark)
    with open(vocabulary, "rb") as f:
        entries = json.loads(f.read())
    top = max([len(entries["model"]["vocab"]) - 1, end_id or 0, *(t["id"] for t in entries.get("added_tokens", []))])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    files = max(1, -(-total_bytes(rows, "text") // file_bytes))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    writer = (rows.repartitionByRange(files, *order[:2]).sortWithinPartitions(*order).write.format(FORMAT).mode("overwrite")
              .option("vocabulary", vocabulary).option("width", 2 if top < 1 << 16 else 4))
    (writer if end_id is None else writer.option("end_id", end_id)).save(path)


def read_records(spark: SparkSession, path: str, ids: str = "array", seed: int | None = None) -> DataFrame:
    """Rows (id, start, n_tokens, ids) of a table that write_records wrote; start: ids of all sequences before it. With a
    seed, rows come in an order drawn by it, by seeking through the index."""
    register(spark)
    reader = spark.read.format(FORMAT).option("ids", ids)
    return (reader if seed is None else reader.option("seed", seed)).load(path)
