"""Token counts with overlap resynchronisation (operator 5).

A huge document is encoded in overlapping chunks with offsets. Two neighbouring
chunks are spliced at a token border inside their overlap that both encodings
have and that is *proven stable*: no vocabulary piece holds the two characters
that meet there, so no merge can ever cross it and the tokens on either side do
not depend on the other side. If the overlap holds no such border, it is widened
(up to the rest of the document), so counts always equal those of the whole text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Characters of a chunk and of the first overlap; a text of one chunk is encoded as it is.
CHUNK_CHARS, OVERLAP_CHARS = 32_768, 256

SPACE = "▁"


class TokenCounter:
    """Counts (and encodes) whole texts with a sentencepiece model or a tokenizers file."""

    def __init__(self, data: bytes, kind: str):
        self.kind = kind
        if kind == "model":
            import sentencepiece
            from sentencepiece import sentencepiece_model_pb2 as pb

            self.sp = sentencepiece.SentencePieceProcessor(model_proto=data)
            model = pb.ModelProto()
            model.ParseFromString(data)
            spec = model.normalizer_spec
            # merges can only be proven independent where the text itself is what is merged
            self.stable = (model.trainer_spec.model_type == 2 and not spec.precompiled_charsmap and not spec.remove_extra_whitespaces
                           and spec.escape_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
                           and not any(p.type in (4, 5) for p in model.pieces))
            self.joined = {a + b for p in model.pieces if p.type == 1 for a, b in zip(p.piece, p.piece[1:], strict=False)}
        else:
            from tokenizers import Tokenizer

            self.tok = Tokenizer.from_str(data.decode())
            self.tok.no_truncation()
            self.tok.no_padding()
            self.stable = False

    def ids(self, text: str) -> list[int]:
        if self.kind == "model":
            return self.sp.encode(text, num_threads=1)
        return self.tok.encode(text, add_special_tokens=False).ids

    def _pieces(self, text: str) -> list[tuple[int, int]]:
        """(id, character at which the token begins) of each token."""
        pieces = self.sp.encode(text, return_type="proto", num_threads=1).pieces
        if text.isascii():
            return [(p.id, p.begin) for p in pieces]
        # the library's offsets are bytes of the UTF-8 text
        heads = np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0 != 0x80
        chars = np.concatenate(([0], np.cumsum(heads))).tolist()
        return [(p.id, chars[p.begin]) for p in pieces]

    def _stable_at(self, text: str, at: int) -> bool:
        a, b = text[at - 1], text[at]
        return (SPACE if a == " " else a) + (SPACE if b == " " else b) not in self.joined

    def encode(self, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
        """Ids of a whole text; equal to ids(text) for every chunk and overlap."""
        if len(text) <= chunk + overlap or not self.stable:
            return self.ids(text)
        out: list[int] = []
        begin, skip = 0, 0  # where the chunk begins, and the splice up to which its tokens are known
        while True:
            end, wide = begin + chunk, overlap
            while True:
                stop = min(len(text), max(end, skip) + wide)
                left = self._pieces(text[begin:stop])
                if stop == len(text):
                    return out + [i for i, at in left if begin + at >= skip]
                right_begin = max(end, skip)
                right = {right_begin + at for _, at in self._pieces(text[right_begin:stop])}
                splice = next((at for at in (begin + x for _, x in left) if at > right_begin and at in right
                               and self._stable_at(text, at)), None)
                if splice is not None:
                    break
                wide *= 4
            out += [i for i, at in left if skip <= begin + at < splice]
            begin, skip = right_begin, splice

    def count(self, text: str) -> int:
        return len(self.encode(text))


_LOADED: dict[str, TokenCounter] = {}


def loaded(data: bytes, kind: str) -> TokenCounter:
    key = hashlib.sha256(data).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = TokenCounter(data, kind)
    return _LOADED[key]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of whole texts.

    Result, a row per input row in any order: ``id_col``, ``n_bytes`` long (UTF-8),
    ``n_tokens`` long, ``over_limit`` boolean (n_tokens > limit). Counts are those of the
    library of ``vocabulary`` (``.model``: sentencepiece, ``.json``: tokenizers) for the
    whole text without added tokens. A null or empty text has 0 of both; a null id stays
    null; repeated rows stay repeated; further columns are ignored. The vocabulary file
    (a few MB) is read on the driver and sent to the tasks once.
    """
    kind = vocabulary.rsplit(".", 1)[-1]
    with open(vocabulary, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()),
              T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(data.value, kind)
        for batch in batches:
            sizes, counts = [], []
            for cell in batch.column(1):
                text = cell.as_py() or ""
                sizes.append(len(text.encode()))
                counts.append(counter.count(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()),
                 pa.array([n > limit for n in counts], pa.bool_())], names=[f.name for f in fields])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))
