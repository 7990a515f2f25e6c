"""Byte-level BPE encoding and decoding (operator 2).

A piece is encoded left to right: its bytes are mapped to Latin-1 characters, an
Aho-Corasick automaton over the vocabulary gives the longest token at each place,
and the encoder backtracks to shorter tokens until each adjacent pair of tokens is
*compatible*, i.e. merging the two tokens' bytes by rank would give just this pair.
The only sequence of compatible neighbours is the result of the merges themselves,
so the ids are exact. Compatibility is memoised, which makes the work linear in the text.
A batch of texts is encoded by its distinct units (``units.py``), so a word that a corpus
repeats goes through the automaton once; the memos are bounded and are only caches.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from aerocast.llm.common import HELD, large_binaries
from aerocast.llm.units import CUT_PATTERN, UnitCoder

class ByteBpe:
    """Encoder and decoder for a table bytes -> rank (rank = token id)."""

    #: Units and pairs of tokens that are remembered; Python workers keep them between stages.
    MEMO, PAIRS = 1_000_000, 120_000

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.split = self._splits()
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            if i in self.split:
                self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.size = [len(t) for t in self.tokens]
        self.shorter = [self._shorter(t) for t in self.tokens]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.length = np.array(self.size, dtype=np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.coder = UnitCoder(self._units, "<u4", self.MEMO, cuts=pattern == CUT_PATTERN)

    def _splits(self) -> dict[int, tuple[int, int] | None]:
        """The last merge of each token that merging its own bytes gives; None for one byte.
        Tokens that their bytes do not merge to are left out: they never occur."""
        out: dict[int, tuple[int, int] | None] = {}
        for token, i in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                out[i] = None
                continue
            parts = self.merge(token, stop=2)
            if len(parts) == 2:
                out[i] = (self.ranks[parts[0]], self.ranks[parts[1]])
        return out

    def merge(self, piece: bytes, stop: int = 1) -> list[bytes]:
        """Plain merging by lowest rank, leftmost first, until ``stop`` parts are left."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > stop:
            best = min(((self.ranks.get(a + b, 1 << 62), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best[0] == 1 << 62:
                break
            k = best[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _shorter(self, token: bytes) -> int:
        """Id of the longest proper prefix that is a possible token, -1 if there is none."""
        for n in range(len(token) - 1, 0, -1):
            i = self.ranks.get(token[:n], -1)
            if i in self.split:
                return i
        return -1

    def compatible(self, left: int, right: int) -> bool:
        """True if no merge by rank would join across the border of the two tokens; memoised."""
        known = self._compatible(left, right)
        if len(self.pairs) >= self.PAIRS:
            self.pairs.clear()
        self.pairs[left << 32 | right] = known
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # Undo the two tokens' merges, the latest first (of equal ranks the right one, as the
        # leftmost is merged first). A merge across the border that ranks before the merge just
        # undone would have come first, so the pair cannot stand.
        ranks, tokens, split = self.ranks, self.tokens, self.split
        limit = 1 << 62
        while True:
            if ranks.get(tokens[a] + tokens[b], limit) < limit:
                return False
            undo_left, undo_right = split[a], split[b]
            if undo_left is None and undo_right is None:
                return True
            if undo_right is None or (undo_left is not None and a > b):
                limit, a = a, undo_left[1]
            else:
                limit, b = b + 1, undo_right[0]

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]  # as the library does: a piece that is a token is that token
        n = len(piece)
        longest, size, shorter, memo = [-1] * n, self.size, self.shorter, self.pairs.get
        for end, i in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - size[i]] = i  # ends come in order, so the longest stays
        dead = bytearray(n + 1)  # places from which no compatible sequence reaches the end
        out: list[int] = []
        at, last, token = 0, -1, longest[0]
        while True:
            to = at + size[token]
            if not dead[to]:
                fits = True if last < 0 else memo(last << 32 | token)
                if fits is None:
                    fits = self.compatible(last, token)
                if fits:
                    out.append(token)
                    if to == n:
                        return out
                    at, last, token = to, token, longest[to]
                    continue
            token = shorter[token]
            while token < 0:
                if not out:
                    return [self.ranks[p] for p in self.merge(piece)]
                dead[at] = 1
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else -1
                token = shorter[token]

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        return np.array([i for p in self.pattern.findall(text) for i in self.piece(p.encode())], dtype="<u4").tobytes()

    def _units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [[i for p in self.pattern.findall(u.decode()) for i in self.piece(p.encode())] for u in units]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), "<u4", int(size.sum())), size

    def decoded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, and the number of bytes before each, with the total."""
        size = self.length[ids]
        done = np.concatenate(([0], np.cumsum(size)))
        return self.flat[np.repeat(self.begin[ids] - done[:-1], size) + np.arange(done[-1])], done

    def decode(self, ids: bytes) -> bytes:
        """The bytes of a text from its ids."""
        return self.decoded(np.frombuffer(ids, dtype="<u4"))[0].tobytes()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


_LOADED: dict[str, ByteBpe] = {}
HELD.append(_LOADED)


def loaded(data: bytes, pattern: str) -> ByteBpe:
    """The encoder of a vocabulary file's bytes, made once in each Python worker."""
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBpe(parse_ranks(data), pattern)
    return _LOADED[key]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                     with_ids: bool = True, with_bytes: bool = True) -> DataFrame:
    """Encodes each whole text and decodes the ids again.

    Result, a row per input row in any order: ``id_col``, ``n_tokens`` long, ``ids``
    array<int> (if ``with_ids``), ``decoded`` binary (if ``with_bytes`` too), ``ids_sha256``
    and ``decoded_sha256`` (lower-case hex; ids as little-endian unsigned 32-bit integers).
    A null or empty text has no tokens; a null id stays null; repeated rows stay
    repeated; columns besides the two named are ignored. ``vocabulary`` is the path of a
    rank file on the driver (a few MB, sent to the tasks once); texts are never cut.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())
    id_type = docs.schema[id_col].dataType
    fields = [T.StructField(id_col, id_type), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
              T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
        if with_bytes:
            fields.append(T.StructField("decoded", T.BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(data.value, pattern)
        for batch in batches:
            for at, to, ids, ends in bpe.coder.slices(large_binaries(batch.column(1))):
                raw, done = bpe.decoded(ids)
                places = done[ends]
                spans = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
                cols = [batch.column(0).slice(at, to - at), pa.array(np.diff(ends)), pa.array([hashlib.sha256(ids[a:b]).hexdigest() for a, b in spans], pa.string()),
                        pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)], pa.string())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32))))
                    if with_bytes:
                        cols.append(pa.array([raw[a:b].tobytes() for a, b in zip(places[:-1], places[1:], strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))
