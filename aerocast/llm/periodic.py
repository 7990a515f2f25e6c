"""Periodic runs of words, found over all periods at once (operator 11).

A *run* is a stretch of consecutive words with smallest period q, at least ``exponent``
times q and ``least`` words long, that no neighbouring word extends. Periods are taken by
octaves [P, 2P). In an octave, boundaries stand at the multiples of P, and a boundary's
*Z-function* (longest match of the words from the boundary on with those from each later
place on) gives all periods of the octave that hold across it, in time linear in P; a run
of exponent 4 matches itself, shifted by its period, over at least 3P places, so some
boundary sees two whole blocks. All octaves together so cost n log n, whatever the text.
Boundaries at which no place of the octave agrees in its first words are left out before,
by comparing shifted arrays; the periods below 8 are compared that way altogether.

Tiles: a document up to LONG_BYTES, like all the documents of an Arrow slice with it, is
one tile per octave and is solved where it is read. A longer one is exploded into
overlapping tiles, whose length grows with the octave, and the tiles are shuffled and
solved on their own. What a tile finds are *fragments* (document, period, first place,
place after the last at which word = word one period on). Fragments are shuffled by
document and period and stitched where they touch; a stretch found under several periods
keeps the smallest. Words are coded by exact comparison, so no result rests on a hash but
the documents' keys (MD5 of id and text, as join keys only).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerocast.llm.common import large_binaries, slices, word_spans

#: Documents with more bytes are exploded into tiles; words that a tile of the small octaves owns.
LONG_BYTES, TILE_WORDS = 256 << 10, 1 << 15
#: Periods below this are compared place by place.
DIRECT = 8
#: Words that must agree before a Z-function is computed.
FIRST_WORDS = 12

FRAGMENT_DDL = "key binary, period long, lo long, hi long"
TILE_DDL = "key binary, base long, own_from long, own_to long, first long, last long, words long, codes binary"

Rearrange = Callable[[int | None, int], np.ndarray | None]


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words."""
    size = ends - starts
    where = np.concatenate(([0], np.cumsum(size)))
    solid = data[np.repeat(starts - where[:-1], size) + np.arange(where[-1])]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(where.astype(np.int64)), pa.py_buffer(solid)])
    return np.asarray(words.dictionary_encode().indices).astype(np.int32)


def z_function(s: list[int]) -> list[int]:
    """z[i]: length of the longest common prefix of s and s[i:]; z[0] is the whole length."""
    n = len(s)
    z = [n] * n if n else []
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def matches_needed(q: np.ndarray | int, least: int, exponent: int):
    """Places at which a run of period q equals itself one period on, at least."""
    return np.maximum(least - q, (exponent - 1) * q)


def direct(seq: np.ndarray, q: int, need: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Stretches [lo, hi) with seq[x] == seq[x + q]; at the ends of a part of a document also short ones."""
    if len(seq) <= q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    off = np.concatenate(([-1], np.flatnonzero(seq[:-q] != seq[q:]), [len(seq) - q]))
    size = np.diff(off) - 1
    keep = size >= need
    if not whole:
        keep[[0, -1]] |= size[[0, -1]] > 0
    at = np.flatnonzero(keep)
    return off[at] + 1, off[at + 1]


def octave(seq: np.ndarray, P: int, base: int, own_from: int, own_to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(period, lo, hi) of the stretches of periods in [P, 2P) that two whole blocks at an own boundary match.
    ``base`` is the place of seq[0]; boundaries are multiples of P among the places [own_from, own_to) of seq."""
    none = (np.zeros(0, np.int64),) * 3
    m = len(seq)
    b0 = own_from + -(base + own_from) % P
    nb = -(-(min(own_to, m - 3 * P + 1) - b0) // P)
    if nb <= 0:
        return none
    bi, qi = np.nonzero(seq[b0 + P:b0 + P + nb * P].reshape(nb, P) == seq[b0:b0 + nb * P:P][:, None])
    b, q = b0 + bi * P, P + qi
    fits = b + q + 2 * P <= m
    b, q = b[fits], q[fits]
    for j in (2 * P - 1, *range(1, min(FIRST_WORDS, 2 * P - 1))):
        if not len(b):
            return none
        same = seq[b + j] == seq[b + q + j]
        b, q = b[same], q[same]
    qs, bs, ends = [], [], []
    for at in np.unique(b).tolist():
        z = np.array(z_function(seq[at:at + 5 * P].tolist()), dtype=np.int64)
        found = P + np.flatnonzero(z[P:2 * P] >= 2 * P)
        if len(found):
            # smallest period of the first q words: the first d with d + z[d] >= q; if it divides q, q is no smallest period
            reach = np.maximum.accumulate(np.arange(1, 2 * P) + z[1:2 * P])
            small = np.minimum(np.searchsorted(reach, found) + 1, found)
            found = found[(small == found) | (found % small > 0)]
            qs.append(found)
            bs.append(np.full(len(found), at))
            ends.append(at + z[found])
    if not qs:
        return none
    q, b, end = np.concatenate(qs), np.concatenate(bs), np.concatenate(ends)
    if not len(q):
        return none
    order = np.lexsort((b, q))
    q, b, end = q[order], b[order], end[order]
    new = np.ones(len(q), dtype=bool)
    new[1:] = (q[1:] != q[:-1]) | (b[1:] != b[:-1] + P)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(q)) - 1
    lo = np.empty(len(first), np.int64)
    for k, (period, at) in enumerate(zip(q[first].tolist(), b[first].tolist(), strict=True)):
        begin = max(0, at - P)
        off = np.flatnonzero(seq[begin:at] != seq[begin + period:at + period])
        lo[k] = begin + int(off[-1]) + 1 if len(off) else begin
    return q[first].astype(np.int64), lo, end[last].astype(np.int64)


def fragments(seq: np.ndarray, first: int, last: int, least: int, exponent: int, base: int = 0, own_from: int = 0,
              own_to: int | None = None, whole: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(period, lo, hi) in places of seq for the octaves P = first, 2 * first, ... up to last."""
    parts = []
    P = first
    while P <= last:
        if P < DIRECT:
            for q in range(P, 2 * P):
                lo, hi = direct(seq, q, int(matches_needed(q, least, exponent)), whole)
                parts.append((np.full(len(lo), q, np.int64), lo, hi))
        else:
            parts.append(octave(seq, P, base, own_from, len(seq) if own_to is None else own_to))
        P *= 2
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    q, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
    if whole:
        keep = hi - lo >= matches_needed(q, least, exponent)
        q, lo, hi = q[keep], lo[keep], hi[keep]
    return q, lo, hi


def document_words(data: np.ndarray, offsets: np.ndarray, ids: list, rearrange: Rearrange | None):
    """(starts, ends, word in the text of each word place, first place of each document with the total)."""
    starts, ends, first = word_spans(data, offsets)
    order = np.arange(len(starts))
    if rearrange is not None:
        for k, i in enumerate(ids):
            n = int(first[k + 1] - first[k])
            moved = rearrange(i, n) if n else None
            if moved is not None:
                order[first[k]:first[k + 1]] = first[k] + moved
    return starts, ends, order, first


def _periods(n: int) -> int:
    """The last octave that a document of n words can have runs in, for any exponent of 4 and more."""
    return n // 4


# ------------------------------------------------------------------ tasks
def _fragment_batch(keys: list, which: np.ndarray, q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()).take(pa.array(which)), pa.array(q), pa.array(lo), pa.array(hi)], names=["key", "period", "lo", "hi"])


def _solve_whole(least: int, exponent: int, rearrange: Rearrange | None):
    """(key, id, text) -> fragments, all documents of an Arrow slice in one sequence with distinct marks between them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column(0), batch.column(1).to_pylist()
            for at, to, data, offsets in slices(large_binaries(batch.column(2))):
                starts, ends, order, first = document_words(data, offsets, ids[at:to], rearrange)
                if not len(starts):
                    continue
                seq = np.insert(word_codes(data, starts, ends)[order], first[1:], -1 - np.arange(to - at, dtype=np.int32))
                q, lo, hi = fragments(seq, 1, _periods(int(np.diff(first).max())), least, exponent)
                begin = first[:-1] + np.arange(to - at)
                which = np.searchsorted(begin, lo, side="right") - 1
                yield _fragment_batch(keys.slice(at, to - at).to_pylist(), which, q, lo - begin[which], hi - begin[which])
    return run


def _tiles(tile_words: int, rearrange: Rearrange | None):
    """(key, id, text) -> overlapping tiles: one series for the small octaves, one for each larger octave."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, to, data, offsets in slices(large_binaries(batch.column(2)), 1):
                starts, ends, order, first = document_words(data, offsets, ids[at:to], rearrange)
                codes = word_codes(data, starts, ends)[order]
                for k in range(to - at):
                    yield from _tile_rows(keys[at + k], codes[first[k]:first[k + 1]], tile_words)
    return run


def _tile_rows(key: bytes, codes: np.ndarray, tile_words: int) -> Iterator[pa.RecordBatch]:
    n = len(codes)
    small = 1
    while 32 * small <= tile_words:
        small *= 2
    series = [(1, small, tile_words)]
    while 2 * series[-1][1] <= _periods(n):
        series.append((2 * series[-1][1],) * 2 + (32 * series[-1][1],))
    for first, last, own in series:
        for a in range(0, n, own):
            begin, end = max(0, a - last), min(n, a + own + 5 * last)
            row = [key, begin, a - begin, min(n, a + own) - begin, first, last, n, codes[begin:end].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["key", "base", "own_from", "own_to", "first", "last", "words", "codes"])


def _solve_tiles(least: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                seq = np.frombuffer(t["codes"], np.int32)
                q, lo, hi = fragments(seq, t["first"], t["last"], least, exponent, t["base"], t["own_from"], t["own_to"], whole=len(seq) == t["words"])
                yield _fragment_batch([t["key"]], np.zeros(len(q), np.int64), q, lo + t["base"], hi + t["base"])
    return run


def _collapse(rearrange: Rearrange | None):
    """(id, text, runs) -> (id, number of words, runs, kept words joined by one space)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, runs = batch.column(0).to_pylist(), batch.column(2)
            for at, to, data, offsets in slices(large_binaries(batch.column(1))):
                starts, ends, order, first = document_words(data, offsets, ids[at:to], rearrange)
                keep = np.ones(len(order), dtype=bool)
                mine = runs.slice(at, to - at)
                for k in np.flatnonzero(np.asarray(mine.is_valid())).tolist():
                    for r in mine[k].as_py():
                        keep[first[k] + r["start"] + r["period"]:first[k] + r["start"] + r["length"]] = False
                kept = order[keep]
                where = np.concatenate(([0], np.cumsum(keep)))[first]  # kept words before each document
                size = ends[kept] - starts[kept] + 1
                done = np.concatenate(([0], np.cumsum(size)))
                out = np.full(done[-1], 0x20, np.uint8)
                text = np.repeat(starts[kept] - done[:-1], size) + np.arange(done[-1])
                solid = np.ones(done[-1], dtype=bool)
                solid[done[1:] - 1] = False
                out[solid] = data[text[solid]]
                # the space after a document's last word goes
                drop = done[where[1:]][np.diff(where) > 0] - 1
                texts = np.delete(out, drop)
                marks = done[where] - np.concatenate(([0], np.cumsum(np.diff(where) > 0)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.array(np.diff(first).astype(np.int64)), mine,
                     pa.LargeStringArray.from_buffers(to - at, pa.py_buffer(marks.astype(np.int64)), pa.py_buffer(texts)).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "text"])
    return run


# ------------------------------------------------------------------ Spark
def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, id, text): rows equal in id and text share a key, as they share their runs."""
    text, i = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    key = F.unhex(F.md5(F.concat(F.coalesce(i.cast("string"), F.lit("-")), F.lit(" "), text)))
    return docs.select(key.alias("key"), i.alias("doc_id"), text.alias("text"))


def find_fragments(rows: DataFrame, least: int, exponent: int, rearrange: Rearrange | None, long_bytes: int, tile_words: int) -> DataFrame:
    length = F.octet_length("text")
    near = rows.filter(length <= long_bytes).mapInArrow(_solve_whole(least, exponent, rearrange), FRAGMENT_DDL)
    tiles = rows.filter(length > long_bytes).mapInArrow(_tiles(tile_words, rearrange), TILE_DDL)
    far = tiles.repartition("key", "first", "base").mapInArrow(_solve_tiles(least, exponent), FRAGMENT_DDL)
    return near.union(far)


def stitched(found: DataFrame, least: int, exponent: int) -> DataFrame:
    """(key, start, length, period) of the runs: touching fragments of a document and period are one stretch; stretches
    that are too short go; of the same words under several periods the smallest stays."""
    mine = Window.partitionBy("key", "period").orderBy("lo")
    reach = F.max("hi").over(mine.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("new", F.when(F.col("lo") <= reach, 0).otherwise(1))
    parts = marked.withColumn("part", F.sum("new").over(mine.rowsBetween(Window.unboundedPreceding, 0)))
    whole = parts.groupBy("key", "period", "part").agg(F.min("lo").alias("start"), F.max("hi").alias("hi"))
    need = F.greatest(F.lit(least) - F.col("period"), F.lit(exponent - 1) * F.col("period"))
    whole = whole.filter(F.col("hi") - F.col("start") >= need)
    length = (F.col("hi") - F.col("start") + F.col("period")).alias("length")
    return whole.groupBy("key", "start", length).agg(F.min("period").alias("period"))


def collapse_runs(docs: DataFrame, least: int = 6, exponent: int = 4, rearrange: Rearrange | None = None, id_col: str = "doc_id",
                  text_col: str = "text", long_bytes: int = LONG_BYTES, tile_words: int = TILE_WORDS) -> DataFrame:
    """Runs of each whole text, and the text with each run cut to its first period.

    Words are `[^\\x20\\x09-\\x0D]+`, compared as they are. ``rearrange(id, n)`` may give the order in which the n words
    of a document are read (None: as they stand). ``exponent`` must be 4 or more.
    Result, a row per input row in any order: doc_id, n_words, runs array<struct<start, length, period>> by start, then
    period (empty: no run), text (the kept words joined by one space; a word is dropped if any run holds it after that
    run's first period). Null and empty texts have no words; null ids stay null; repeated rows stay repeated; columns
    besides the two named are ignored; an empty table gives an empty result.
    """
    if exponent < 4:
        raise ValueError("boundaries see all runs of exponent 4 and more only")
    rows = keyed(docs, id_col, text_col)
    runs = stitched(find_fragments(rows, least, exponent, rearrange, long_bytes, tile_words), least, exponent)
    item = F.struct("start", "period", "length")
    each = runs.groupBy("key").agg(F.sort_array(F.collect_list(item)).alias("runs"))  # no more than a document's own length gives
    each = each.withColumn("runs", F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))))
    joined = rows.join(each, "key", "left").select("doc_id", "text", "runs")
    ddl = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, text string"
    out = joined.mapInArrow(_collapse(rearrange), ddl)
    return out.withColumn("runs", F.coalesce("runs", F.array().cast("array<struct<start: long, length: long, period: long>>")))
