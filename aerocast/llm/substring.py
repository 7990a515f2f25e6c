"""Substring dedup with fixed-block anchors (operator 8).

Every document is cut into non-overlapping reference blocks of half a window's words. A
repeated window holds at least one whole reference block of the document it repeats, so
probing the index of blocks with every rolling run of that length finds an anchor in
every repeat. Around the anchors the hits are extended: each full window that holds an
anchor is compared over the corpus by 96 bits and more of hash, and the union of the
windows that also start in a smaller document is the maximal repeat, which is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerocast.llm import exchange
from aerocast.llm.common import clean_documents, large_binaries, slices, text_hashes, window_hashes, windows_in_rows, word_spans

WINDOW = 50
SALT = 0x6A09E667


@dataclass
class _Words:
    """The words of some texts: bytes, their rows' offsets, word spans, the rows' first words, hashes."""
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    head: np.ndarray
    hashes: np.ndarray

    @classmethod
    def of(cls, column) -> _Words:
        for _, _, data, offsets in slices(large_binaries(column), 1 << 62):
            starts, ends, head = word_spans(data, offsets)
            return cls(data, offsets, starts, ends, head, text_hashes(data, starts, ends))
        none = np.zeros(0, np.int64)
        return cls(np.zeros(0, np.uint8), np.zeros(1, np.int64), none, none, np.zeros(1, np.int64), np.zeros(0, np.uint64))

    def row(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.head, at, side="right") - 1


def _anchors(words: _Words, ids: np.ndarray, block: int, bits: int):
    """Distinct keys of all runs of ``block`` words: keys, index of each run's key, the runs' first words, whether a
    reference block has the key, whether two documents have it."""
    at = windows_in_rows(words.head, block)
    if not len(at):
        return np.zeros(0, np.uint64), at, at, np.zeros(0, bool), np.zeros(0, bool)
    row = words.row(at)
    key = window_hashes(words.hashes, block)[at] >> np.uint64(32 - bits)  # a filter only: 32 bits within the bucket
    order = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.diff(key[order], prepend=key[order[0]] ^ np.uint64(1)))
    index = np.empty(len(key), dtype=np.int64)
    index[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(key))))
    aligned = (at - words.head[row]) % block == 0
    blocks = np.zeros(len(new), dtype=bool)
    blocks[index[aligned]] = True
    own = ids[row][order]
    shared = np.minimum.reduceat(own, new) < np.maximum.reduceat(own, new)
    return key[order[new]], index, at, blocks, shared


def _candidates(words: _Words, ids: np.ndarray, anchored: np.ndarray, window: int, block: int):
    """Distinct windows that hold an anchor: their two hashes, index of each window's, the windows' first words, and
    the smallest doc_id here that has them."""
    at = windows_in_rows(words.head, window)
    seen = np.zeros(len(words.starts) + 1, dtype=np.int64)
    seen[anchored + 1] = 1
    seen = np.cumsum(seen)
    at = at[seen[at + window - block + 1] > seen[at]]
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), at, at, at
    one = window_hashes(words.hashes, window)[at]
    two = (window_hashes(words.hashes, window, salt=SALT)[at] >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    index = np.empty(len(at), dtype=np.int64)
    index[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(at))))
    return a[new], b[new], index, at, np.minimum.reduceat(ids[words.row(at)][order], new)


def _kept(words: _Words, keep: np.ndarray) -> Iterator[bytes]:
    """The kept words of each row, joined by one space."""
    row = words.row(np.arange(len(keep)))
    left = np.flatnonzero(keep)
    follows = np.zeros(len(left), dtype=bool)
    follows[:-1] = row[left[1:]] == row[left[:-1]]
    step = np.zeros(len(words.data) + 2, dtype=np.int8)
    step[words.starts[left]] += 1
    ends = words.ends[left]
    np.add.at(step, ends + follows, -1)  # a word that another one follows takes the white space behind it along
    mask = np.cumsum(step[:len(words.data)], dtype=np.int8).astype(bool)
    data = words.data.copy()
    data[ends[follows]] = 0x20
    out = data[mask].tobytes()
    at = np.concatenate(([0], np.cumsum(mask)))[words.offsets]
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield out[a:b]


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """Removes every word covered by a window that also starts in a document with a smaller doc_id.

    Words are runs of non-space bytes, unchanged; a window is ``window`` (at least 2)
    consecutive words of one document, judged on the input. Result, a row per input row:
    ``doc_id``, ``n_words``, ``n_removed`` (long), ``kept_sha256`` (of the kept words joined
    by one space, UTF-8) and, if ``with_text``, ``text`` (those words). Null, empty and short
    texts lose nothing. Rows that repeat a doc_id are one document: they don't remove each
    other's words. Rows with a null doc_id lose nothing and are compared with nothing. Only
    doc_id and text are read; an empty table gives an empty result.
    """
    block = window // 2
    chunks, bits = exchange.chunked(docs)
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    fields += [("text", pa.string())] * with_text

    def split(key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(32)).astype(np.int64)

    def first(table: pa.Table) -> pa.Table:
        key, _, _, blocks, shared = _anchors(_Words.of(table.column("text")), np.asarray(table.column("doc_id")), block, bits)
        return exchange.cells(table.column("chunk")[0].as_py(), split(key), [key.astype(np.uint32)], [blocks, shared])

    def sum_first(table: pa.Table) -> pa.Table:
        chunk, at, (key, blocks, shared) = exchange.columns_of(table, ["<u4"], 2)
        _, index, times = np.unique(key, return_inverse=True, return_counts=True)
        any_block, any_shared = np.zeros(len(times), bool), times > 1
        any_block[index[blocks]] = True
        any_shared[index[shared]] = True
        hit = (any_block & any_shared)[index]
        return exchange.replies(1, table, chunk, at, lambda s: np.packbits(hit[s]).tobytes())

    def found(table: pa.Table, answer: pa.Table):
        words, ids = _Words.of(table.column("text")), np.asarray(table.column("doc_id"))
        key, index, at, _, _ = _anchors(words, ids, block, bits)
        sizes = np.unique(split(key), return_counts=True)[1]
        hit = exchange.bits_of(exchange.answers(answer, 1), sizes)
        return words, ids, _candidates(words, ids, at[hit[index]] if len(at) else at, window, block)

    def bucket_of(one: np.ndarray) -> np.ndarray:
        return (one >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(one), np.int64)

    def second(table: pa.Table, answer: pa.Table) -> pa.Table:
        if not table.num_rows:
            return exchange.CELL.empty_table()
        _, _, (one, two, *_) = found(table, answer)
        return exchange.cells(table.column("chunk")[0].as_py(), bucket_of(one), [one, two], [])

    def sum_second(table: pa.Table) -> pa.Table:
        chunk, at, (one, two) = exchange.columns_of(table, ["<u8", "<u4"], 0)
        order = np.lexsort((np.arange(len(one)), two, one))  # cells are in the order of the chunks
        a, b = one[order], two[order]
        earlier = np.empty(len(one), dtype=bool)
        earlier[order] = np.concatenate(([False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])))
        return exchange.replies(2, table, chunk, at, lambda s: np.packbits(earlier[s]).tobytes())

    def rows(words: _Words, ids: pa.ChunkedArray, removed: np.ndarray) -> pa.Table:
        gone = np.concatenate(([0], np.cumsum(removed)))[words.head]
        texts = list(_kept(words, ~removed))
        cols = [ids.cast(pa.int64()), pa.array(np.diff(words.head), pa.int64()), pa.array(np.diff(gone), pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
        return pa.table(cols + [pa.array([t.decode() for t in texts], pa.string())] * with_text, schema=pa.schema(fields))

    def result(table: pa.Table, answer: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.schema(fields).empty_table()
        words, ids, (one, _, index, at, lowest) = found(table, answer)
        removed = np.zeros(len(words.starts) + 1, dtype=np.int64)
        if len(at):
            sizes = np.unique(bucket_of(one), return_counts=True)[1]
            earlier = exchange.bits_of(exchange.answers(answer, 2), sizes)
            later = at[earlier[index] | (lowest[index] < ids[words.row(at)])]
            np.add.at(removed, later, 1)
            np.add.at(removed, later + window, -1)
        return rows(words, table.column("doc_id"), np.cumsum(removed[:-1]) > 0)

    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text
    compared = exchange.two_rounds(chunks, first, sum_first, second, sum_second, result, ddl)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = _Words.of(batch.column(1))
            ids = pa.chunked_array([batch.column(0)])
            yield from rows(words, ids, np.zeros(len(words.starts), dtype=bool)).to_batches()

    return compared.union(clean_documents(docs).filter(F.col("doc_id").isNull()).mapInArrow(untouched, ddl))
