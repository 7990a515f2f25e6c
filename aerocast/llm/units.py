"""Encoding whole batches of texts by their distinct units.

A *unit* is a stretch of a text between two places at which a byte-level BPE with the usual
pattern always begins a piece: before a space that is followed by a byte which can't be
white space, between an ASCII letter or digit and one of ``,.;:!?``, and between a single
line feed after ASCII text and an ASCII letter or digit. The ids of a text are the ids of
its units, one after the other. A batch is cut into units with NumPy, Arrow finds the
distinct ones, and only those not met before go through the tokenizer; the batch's ids
are then gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from aerocast.llm.common import slices

#: Fixed value: the pattern of pieces for which the cuts below are right.
CUT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bytes that may follow the space at a cut. White space can't; neither can bytes that begin Unicode white space
#: (C2, E1, E2, E3), control characters, or "<", which may begin a special string. Not to cut is always right.
_AFTER = np.zeros(256, dtype=bool)
_AFTER[0x21:0x7F] = True
_AFTER[0xC3:0xF5] = True
_AFTER[[0x3C, 0xE1, 0xE2, 0xE3]] = False

_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[*b",.;:!?"]] = True

#: _AFTER for one byte at a time.
AFTER = tuple(_AFTER.tolist())

#: Longer units are not remembered; bytes of text that one step works on.
LONGEST, STEP_BYTES = 64, 1 << 19


def cut(data: np.ndarray, offsets: np.ndarray, inside: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Begins of the units in bytes, with the end as the last, and the index of each row's first unit, with the total."""
    begins = np.zeros(len(data) + 1, dtype=bool)
    if len(data):
        begins[offsets[:-1]] = True  # a row without bytes begins where the next does
    if len(data) and inside:
        left, right = data[:-1], data[1:]
        begins[:-2] |= (left == 0x20) & _AFTER[right]
        begins[1:-1] |= _ALNUM[left] & _STOP[right]
        # white space before the line feed would be a piece with it, or not, by what follows
        begins[2:-1] |= (data[:-2] > 0x20) & (data[:-2] < 0x7F) & (data[1:-1] == 0x0A) & _ALNUM[data[2:]]
    begins[len(data)] = False
    starts = np.append(np.flatnonzero(begins), len(data))
    return starts, np.searchsorted(starts[:-1], offsets)


class UnitCoder:
    """``encode(units) -> (their ids one after the other, number of ids of each)`` on distinct units, of which about
    ``memo`` are remembered; ids are kept as NumPy type ``kind``; without ``cuts`` each text is one unit. Remembered
    units are one Arrow array, looked up by Arrow's hash join, with their ids in a flat array beside it; when it is
    full the half used last stays."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], kind: str = "<u4", memo: int = 100_000,
                 cuts: bool = True):
        self.cuts, self.new, self.kind, self.most, self.step = cuts, encode, np.dtype(kind), max(2, memo), 0
        self.units = pa.array([], pa.large_binary())
        self.flat, self.size, self.used = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _gather(self, slots: np.ndarray) -> np.ndarray:
        """Ids of the slots, one after the other."""
        size = self.size[slots]
        ends = np.cumsum(size)
        begin = np.cumsum(self.size) - self.size
        return self.flat[np.repeat(begin[slots] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]

    def _keep(self, slots: np.ndarray) -> None:
        self.flat, self.units = self._gather(slots), self.units.take(pa.array(slots))
        self.size, self.used = self.size[slots], self.used[slots]

    def _slots(self, units: pa.LargeBinaryArray) -> np.ndarray:
        self.step += 1
        found = np.full(len(units), -1, np.int64)
        hit = np.asarray(pc.index_in(self.units, value_set=units).fill_null(-1))  # the smaller side is hashed
        slots = np.flatnonzero(hit >= 0)
        found[hit[slots]] = slots
        missing = np.flatnonzero(found < 0)
        self.used[found[found >= 0]] = self.step
        if len(missing):
            new = units.take(pa.array(missing))
            ids, sizes = self.new(new.to_pylist())
            found[missing] = np.arange(len(self.size), len(self.size) + len(missing))
            self.units = pa.concat_arrays([self.units, new])
            self.flat = np.concatenate((self.flat, ids.astype(self.kind)))
            self.size = np.concatenate((self.size, sizes))
            self.used = np.concatenate((self.used, np.full(len(missing), self.step)))
        return found

    def slices(self, texts: pa.LargeBinaryArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row after the last, ids of these rows, offset of each row's ids with the total)."""
        for at, to, data, offsets in slices(texts, STEP_BYTES):
            starts, first = cut(data, offsets, self.cuts)
            n = len(starts) - 1
            if not n:
                yield at, to, np.zeros(0, self.kind), np.zeros(to - at + 1, np.int64)
                continue
            units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
            coded = units.dictionary_encode()
            slots = self._slots(coded.dictionary)[np.asarray(coded.indices)]
            ids, ends = self._gather(slots), np.concatenate(([0], np.cumsum(self.size[slots])))
            yield at, to, ids, ends[first]
            if len(self.size) > self.most:
                short = np.asarray(pc.binary_length(self.units)) <= LONGEST
                order = np.argsort(np.where(short, -self.used, 1), kind="stable")[:min(self.most // 2, int(short.sum()))]
                self._keep(np.sort(order))
