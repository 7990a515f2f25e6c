"""Operator 12: round trips, order, framing, checksums, seeks, edge cases."""

import json
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from aerocast.llm.common import large_binaries
from aerocast.llm.token_records import Corrupt, Reader, frame, read_records, unframe, unit_coder, write_records

VOCABULARY = P.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a" * 3000, " \n  x", "x \n", "  a", "don't  stop\r\n\r\n ok", "<|endoftext|>", "a  <|endoftext|>  b <|endoftext|> c",
       " \x85a 　b  c é è", "  Two  spaces\r\n and é 漢字 😀  "]


def plain(rows, end_id=2):
    """(doc_id, start, n, crc) one document after the other."""
    t = Tokenizer.from_file(VOCABULARY)
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def frame_of(spark, rows):
    return spark.createDataFrame([(t, i, "x", 1) for i, t in rows], "text string, doc_id long, ids string, start int")


def test_units_equal_the_library():
    import random
    with open(VOCABULARY, "rb") as f:
        coder = unit_coder(f.read())
    coder.most = 50  # both generations turn over
    t = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(a) for _ in range(rng.randint(0, 80)))
                   for a in (" ab\n", " aA1'!\n\t|<", "the ing", "é漢😀 \x85  x  ", "a", ["<|endoftext|>", " ", "a", "\n"]) for _ in range(200)]
    for part in (texts, texts[::-1]):
        for at, to, ids, ends in coder.slices(large_binaries(pa.array(part))):
            for k in range(at, to):
                assert ids[ends[k - at]:ends[k - at + 1]].tolist() == t.encode(part[k], add_special_tokens=False).ids, part[k]


def test_frames():
    data = frame(7, b"abcd") + frame(None, b"")
    payload, at = unframe(memoryview(data), 0)
    assert bytes(payload[9:]) == b"abcd" and at == len(data) - (8 + 4 + 9 + 4)
    assert unframe(memoryview(data), at)[1] == len(data)
    for k in range(at):
        bad = bytearray(data)
        bad[k] ^= 1
        with pytest.raises(Corrupt):
            unframe(memoryview(bad), 0)
    with pytest.raises(Corrupt):
        unframe(memoryview(data), len(data))


@pytest.mark.parametrize("file_bytes", [1 << 30, 2000])
def test_records_round_trip(spark, tmp_path, file_bytes):
    rows = [(i, f"{t} {i}") for i, t in enumerate(ODD * 20)] + [(-5, None), (10**15, "of the end"), (900, "")]
    path = f"file://{tmp_path}/records"
    write_records(frame_of(spark, rows), path, VOCABULARY, end_id=2, file_bytes=file_bytes)
    manifest = json.loads((tmp_path / "records" / "MANIFEST.json").read_text())
    assert manifest["width"] == 2 and sum(f[1] for f in manifest["files"]) == len(rows)
    assert len(list((tmp_path / "records").glob("part-*"))) == 2 * len(manifest["files"])
    if file_bytes < 10**6:
        assert len(manifest["files"]) > 3
    out = read_records(spark, path).collect()
    got = sorted((r.id, r.start, r.n_tokens, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in out)
    assert got == sorted(plain(rows))
    mixed = [r.id for r in read_records(spark, path, seed=3).collect()]
    assert sorted(mixed) == sorted(r.id for r in out) and mixed != [r.id for r in out]
    assert mixed == [r.id for r in read_records(spark, path, seed=3).collect()] != [r.id for r in read_records(spark, path, seed=4).collect()]
    # again: the old files go, the table is whole
    write_records(frame_of(spark, rows[:5]), path, VOCABULARY, end_id=None)
    assert [r.n_tokens for r in sorted(read_records(spark, path).collect(), key=lambda r: r.id)] == [x[2] - 1 for x in plain(rows[:5])]


def test_repeated_and_null_ids_and_empty_tables(spark, tmp_path):
    rows = [(None, "a b"), (None, "a b"), (None, None), (3, "x"), (3, "x"), (3, "y z"), (1, "w")]
    path = str(tmp_path / "r")
    write_records(frame_of(spark, rows), path, VOCABULARY, end_id=2, file_bytes=1)
    out = sorted(read_records(spark, path, ids="binary").collect(), key=lambda r: r.start)
    assert [r.id for r in out] == [None, None, None, 1, 3, 3, 3]
    at = 0
    for r in out:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    write_records(frame_of(spark, []), str(tmp_path / "e"), VOCABULARY, end_id=2)
    assert read_records(spark, str(tmp_path / "e")).count() == 0


def test_damage_is_found(spark, tmp_path):
    path = str(tmp_path / "r")
    write_records(frame_of(spark, [(i, "some text " * 5) for i in range(10)]), path, VOCABULARY, end_id=2)
    name = json.loads((tmp_path / "r" / "MANIFEST.json").read_text())["files"][0][0]
    file = tmp_path / "r" / f"{name}.rec"
    data = bytearray(file.read_bytes())
    data[len(data) // 2] ^= 4
    file.write_bytes(data)
    reader = Reader(path, False, None)
    with pytest.raises(Corrupt):
        for part in reader.partitions():
            list(reader.read(part))


def test_query(spark, tmp_path):
    from aerocast.llm.queries import QUERIES
    frame_of(spark, [(i, f"{t} {i}") for i, t in enumerate(ODD)]).write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["op12_token_records"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, out)) == sorted(plain([(i, f"{t} {i}") for i, t in enumerate(ODD)]))
