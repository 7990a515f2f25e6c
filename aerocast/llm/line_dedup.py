"""Line dedup with overlapping three-line windows (operator 10).

Each three consecutive lines of a document are a window. A window whose lines
stand earlier in the corpus (smaller doc_id, or the same document further up) is a
later occurrence; all later occurrences are removed, each line that any of them
covers once (covered positions are merged).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerocast.llm.common import SLICE_BYTES, clean_documents, fresh, large_binaries, mix, signed, slices, spare, text_hashes, window_hashes

WINDOW = 3


def _windows(texts: pa.LargeBinaryArray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, line position, two hashes) of each window of the texts."""
    for first, last, data, offsets in slices(texts, SLICE_BYTES):
        feeds = np.flatnonzero(data == 10)
        rows = np.arange(last - first)
        # a line starts at each row's start and after each line feed; starts of empty rows fall together
        starts = np.concatenate((offsets[:-1], feeds + 1))
        row = np.concatenate((rows, np.searchsorted(offsets, feeds, side="right") - 1))
        order = np.lexsort((starts, row))
        starts, row = starts[order], row[order]
        n = len(starts)
        ends = np.empty(n, dtype=np.int64)
        final = np.ones(n, dtype=bool)
        final[:-1] = row[1:] != row[:-1]
        ends[:-1] = starts[1:] - 1
        ends[final] = offsets[1:]
        lines = text_hashes(data, starts, ends)
        head = np.searchsorted(row, rows)
        at = np.arange(n - size + 1) if n >= size else np.zeros(0, dtype=np.int64)
        at = at[row[at] == row[at + size - 1]]
        one, two = window_hashes(lines, size)[at], window_hashes(lines, size, salt=0x51ED27)[at]
        yield first + row[at], at - head[row[at]], one, mix(two)


def later_windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, pos): each window of ``size`` lines that also stands earlier, pos its first line from 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, pos, one, two in _windows(large_binaries(batch.column(2)), size):
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(pos.astype(np.int32)),
                     pa.array(signed(one)), pa.array(signed(two))], names=["doc_id", "text_key", "pos", "h1", "h2"])

    windows = (clean_documents(docs).filter("doc_id IS NOT NULL AND instr(text, '\\n') > 0")
               .select("doc_id", F.xxhash64("text").alias("text_key"), "text")
               .mapInArrow(spare(run), "doc_id long, text_key long, pos int, h1 long, h2 long"))
    place = F.struct("doc_id", "text_key", "pos")
    firsts = (windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
              .filter("first <> last").select("h1", "h2", "first"))
    return windows.join(firsts, ["h1", "h2"]).filter(place > F.col("first")).select("doc_id", "text_key", "pos")


def _without(size: int):
    @F.pandas_udf("text string, n long")
    def cut(text: pd.Series, later: pd.Series) -> pd.DataFrame:
        kept, gone = [], []
        for t, starts in zip(text, later, strict=True):
            if starts is None or t is None:
                kept.append(None)
                gone.append(0)
                continue
            out = np.unique((np.asarray(starts)[:, None] + np.arange(size)).ravel())
            lines = t.split("\n")
            stay = np.ones(len(lines), dtype=bool)
            stay[out] = False
            kept.append("\n".join(lines[i] for i in np.flatnonzero(stay)))
            gone.append(len(out))
        return pd.DataFrame({"text": kept, "n": gone})
    return cut


def dedup_lines(docs: DataFrame, size: int = WINDOW, lines_col: str = "n_lines", removed_col: str = "n_removed") -> DataFrame:
    """Removes repeated runs of ``size`` lines.

    Result, a row per input row: all input columns, ``text`` without the removed lines
    (the kept ones joined by line feeds, as they were), plus ``n_lines`` and ``n_removed``
    (long; other names by ``lines_col``, ``removed_col``). Occurrences are ordered by (doc_id, hash of the whole text, line); the first
    stays, each line covered by a later one goes, in the same document too. Lines end at
    ``\\n`` only and count as they are, empty ones included. A text of fewer lines, empty
    or null, loses nothing (a null text has 0 lines and stays null, an empty one has 1).
    Rows with a null doc_id are kept unchanged and compared with nothing; rows that
    repeat both doc_id and text are one place, so they do not remove each other. Input
    columns of these two names are replaced.

    A window that millions of documents share is counted by partial aggregation; the join
    that marks its later occurrences is one that Spark splits when it is skewed.
    """
    keep = docs.drop(lines_col, removed_col)
    i, key, later, gone = (fresh(docs, c) for c in ("__id", "__key", "__later", "__cut"))
    covered = (later_windows(docs, size).groupBy(F.col("doc_id").alias(i), F.col("text_key").alias(key))
               .agg(F.collect_set("pos").alias(later)))
    joined = keep.join(covered, (keep["doc_id"].cast("long") == covered[i])
                       & (F.xxhash64(keep["text"].cast("string")) == covered[key]), "left")
    # texts that lose nothing do not go to Python
    cut = joined.withColumn(gone, _without(size)(F.when(F.col(later).isNotNull(), F.col("text")), F.col(later)))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    return (cut.withColumns({lines_col: n_lines.cast("long"), removed_col: F.col(f"{gone}.n")})
            .withColumn("text", F.when(F.col(later).isNull(), F.col("text")).otherwise(F.col(f"{gone}.text")))
            .select(*keep.columns, lines_col, removed_col))
