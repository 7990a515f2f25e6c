"""Stupid-backoff language-model scores (operator 9).

The n-gram counts of the whole corpus are tables partitioned by hash; the exploded
n-grams of the documents are joined to them (packed by chunk and bucket, see
exchange.py) and the scores summed per document. A document is scored by the rest of
the corpus: its own occurrences are subtracted from every count.

Unigrams and bigrams go first. A trigram can only occur in another document if both its
bigrams do, so the second round sends just those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerocast.llm import exchange
from aerocast.llm.common import LOWER, clean_documents, large_binaries, slices, span_hashes, window_hashes, windows_in_rows, word_spans

BACKOFF = 0.4
CHUNK_BYTES = 6 << 20


def _planes(counts: np.ndarray, width: int) -> np.ndarray:
    """Bytes of the counts, all lowest bytes first: high ones are mostly zero and compress away."""
    return np.ascontiguousarray(counts.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).ravel()


def _counts(data: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


class _Grams:
    """The n-grams of one order at their first words, within documents: distinct keys and each position's key."""

    def __init__(self, hashes: np.ndarray, head: np.ndarray, orders: tuple[int, ...], doc: np.ndarray, bits: int, only: np.ndarray | None = None):
        self.at, keys = {}, []
        for n in orders:
            at = windows_in_rows(head, n)
            if only is not None:
                at = at[only[at]]
            self.at[n] = at
            keys.append(window_hashes(hashes, n)[at] if len(at) else np.zeros(0, np.uint64))
        # 40 bits within the bucket: a collision of two n-grams has a chance of about one in a million whatever the size
        key = np.concatenate(keys) >> np.uint64(24 - bits)
        self.key, index, self.total = np.unique(key, return_inverse=True, return_counts=True)
        places = np.concatenate([self.at[n] for n in orders])
        pair = index * np.int64(int(doc.max(initial=0)) + 1) + doc[places]
        _, back, times = np.unique(pair, return_inverse=True, return_counts=True)
        own = times[back] if len(back) else np.zeros(0, np.int64)
        ends = np.cumsum([len(self.at[n]) for n in orders])
        self.index = dict(zip(orders, np.split(index, ends[:-1]), strict=True))
        self.own = dict(zip(orders, np.split(own, ends[:-1]), strict=True))

    def cells(self, chunk: int) -> pa.Table:
        bucket = (self.key >> np.uint64(40)).astype(np.int64)
        table = exchange.cells(chunk, bucket, [self.key.astype(np.uint32), (self.key >> np.uint64(32)).astype(np.uint8), self.total.astype("<u4")], [])
        return table

    def elsewhere(self, n: int, parts: list[bytes], words: int) -> np.ndarray:
        """By word: occurrences in other documents of the n-gram that begins there (0 where none begins)."""
        total = np.concatenate([_counts(np.frombuffer(p, np.uint8), 8) for p in parts]) if parts else np.zeros(0, np.int64)
        out = np.zeros(words + n, dtype=np.int64)
        if len(total):
            out[self.at[n]] = total[self.index[n]] - self.own[n]
        return out


def score_documents(docs: DataFrame, backoff: float = BACKOFF) -> DataFrame:
    """Trigram stupid-backoff score of each document against all other documents.

    Words are runs of non-space bytes, A-Z lower-cased; n-grams stay within one text. With
    counts c of the rest of the corpus, N words in the whole corpus and at most two words of
    context, a word scores c(context, word) / c(context) for the longest context with which
    it occurs elsewhere, times ``backoff`` for each word of context given up; without any, its
    score is max(c(word), 1) / N.

    Result, one row per distinct doc_id: ``doc_id``, ``n_words`` (long), ``log_score`` (sum of
    natural logarithms; 0 without words) and ``per_word`` (their mean; null without words).
    Null and empty texts have no words; rows that repeat a doc_id are one document of
    several texts; rows with a null doc_id are left out, of the counts too. Only doc_id and
    text are read; an empty table gives an empty result.
    """
    n_words = int(clean_documents(docs).filter("doc_id IS NOT NULL")
                  .agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).first()["n"] or 0)
    chunks, bits = exchange.chunked(docs, CHUNK_BYTES)

    def words_of(table: pa.Table):
        for _, _, data, offsets in slices(large_binaries(table.column("text")), 1 << 62):
            low = LOWER[data]
            starts, ends, head = word_spans(low, offsets)
            _, group = np.unique(np.asarray(table.column("doc_id")), return_inverse=True)
            return span_hashes(low, starts, ends), head, np.repeat(group, np.diff(head))
        raise ValueError("a chunk without rows")

    def first(table: pa.Table) -> pa.Table:
        hashes, head, doc = words_of(table)
        return _Grams(hashes, head, (1, 2), doc, bits).cells(table.column("chunk")[0].as_py())

    def summing(turn: int):
        def add(table: pa.Table) -> pa.Table:
            chunk, at, (low, high, n) = exchange.columns_of(table, ["<u4", "u1", "<u4"], 0)
            _, index = np.unique(high.astype(np.uint64) << np.uint64(32) | low, return_inverse=True)
            total = np.bincount(index, weights=n).astype(np.int64)[index]
            return exchange.replies(turn, table, chunk, at, lambda s: _planes(total[s], 8).tobytes())
        return add

    def trigrams(hashes, head, doc, answer):
        small = _Grams(hashes, head, (1, 2), doc, bits)
        parts = exchange.answers(answer, 1)
        one, two = (small.elsewhere(n, parts, len(hashes)) for n in (1, 2))
        begins = np.zeros(len(hashes), dtype=bool)
        begins[:-1] = (two[:len(hashes)] > 0)[:-1] & (two[1:len(hashes)] > 0) if len(hashes) else False
        return one, two, _Grams(hashes, head, (3,), doc, bits, only=begins)

    def second(table: pa.Table, answer: pa.Table) -> pa.Table:
        if not table.num_rows:
            return exchange.CELL.empty_table()
        *_, large = trigrams(*words_of(table), answer)
        return large.cells(table.column("chunk")[0].as_py())

    def result(table: pa.Table, answer: pa.Table) -> pa.Table:
        fields = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64()), ("per_word", pa.float64())])
        if not table.num_rows:
            return fields.empty_table()
        hashes, head, doc = words_of(table)
        n = len(hashes)
        one, two, large = trigrams(hashes, head, doc, answer)
        three = large.elsewhere(3, exchange.answers(answer, 2), n)
        place = np.arange(n) - np.repeat(head[:-1], np.diff(head))
        at = np.arange(n)
        # by the last word of each n-gram
        uni, context = one[:n].astype(float), place.copy()
        bi, tri = np.where(place > 0, two[at - 1], 0), np.where(place > 1, three[at - 2], 0)
        log = np.log(np.maximum(uni, 1) / max(1, n_words)) + np.minimum(context, 2) * np.log(backoff)
        with np.errstate(divide="ignore", invalid="ignore"):
            log = np.where(bi > 0, np.log(bi / one[at - 1]) + np.where(place > 1, np.log(backoff), 0.0), log)
            log = np.where(tri > 0, np.log(tri / two[at - 2]), log)
        ids, group = np.unique(np.asarray(table.column("doc_id")), return_inverse=True)
        count = np.bincount(doc, minlength=len(ids))
        total = np.bincount(doc, weights=log, minlength=len(ids))
        return pa.table([pa.array(ids, pa.int64()), pa.array(count, pa.int64()), pa.array(total, pa.float64()),
                         pa.array(total / np.maximum(count, 1), pa.float64(), mask=count == 0)], schema=fields)

    return exchange.two_rounds(chunks, first, summing(1), second, summing(2), result, "doc_id long, n_words long, log_score double, per_word double")
