"""Benchmark decontamination with BM25 and block-max WAND (operator 3).

The benchmark items form an inverted index with BM25 impacts, divided by the score an
item gives itself, in blocks with their maximum. Every passage of every training text
is a query: overlapping runs of words, so long that an item that a text holds whole
lies with at least half of its score in one passage. Block-max WAND returns all items
from the threshold up; a hit counts if the item's question and its answer overlap the text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerocast.llm.common import large_binaries, slices, text_hashes, window_hashes, written

K1, B = 1.2, 0.75
#: Least words of a passage (more if an item is longer); neighbours overlap by half.
PASSAGE_WORDS = 64
#: Least score of a hit as a share of the item's score with itself; 0.5 loses no item held whole.
THRESHOLD = 0.5
#: Least share of the n-grams of the question and of the answer that the text must hold.
QUESTION_OVERLAP, ANSWER_OVERLAP, NGRAM = 0.6, 0.6, 3
#: Postings in a block of the index; items in one broadcast index (more make more indexes, all are searched).
BLOCK, MAX_ITEMS = 16, 20_000
#: Neighbouring items in a block of the first, vectorised bound; cells of its dense sums at a time.
ITEM_BLOCK, DENSE = 4, 1 << 21

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), ord("_"), *range(128, 256)]] = True


def word_hashes(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, word hashes, head) of the lower-cased letter and digit runs."""
    lowered = large_binaries(pc.utf8_lower(texts.fill_null("")))
    for first, last, data, offsets in slices(lowered):
        solid = _WORD[data]
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[offsets] = True
        begin = solid.copy()
        begin[1:] &= ~solid[:-1] | cut[1:-1]
        stop = solid.copy()
        stop[:-1] &= ~solid[1:] | cut[1:-1]
        starts = np.flatnonzero(begin)
        yield first, last, text_hashes(data, starts, np.flatnonzero(stop) + 1), np.searchsorted(starts, offsets)


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): the answer is the last sentence; of one sentence, its last third."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if p]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    k = max(1, len(words) * 2 // 3)
    return " ".join(words[:k]), " ".join(words[k:])


def _grams(words: np.ndarray) -> np.ndarray:
    return np.unique(window_hashes(words, max(1, min(NGRAM, len(words))))) if len(words) else np.zeros(0, np.uint64)


def _one(text: str) -> np.ndarray:
    return np.concatenate([h for _, _, h, _ in word_hashes(pa.array([text]))] or [np.zeros(0, np.uint64)])


@dataclass
class Statistics:
    """Of all items: their number, longest and mean length; and of the terms of an index (sorted) the items that hold them."""
    n: int
    longest: int
    mean: float
    terms: np.ndarray
    n_items: np.ndarray


def _item_terms(items: DataFrame) -> DataFrame:
    """block, length and distinct terms of each item with text, written to the shared folder."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, _one(t)) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t.strip()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in rows], pa.int32()), pa.array([len(w) for _, w in rows], pa.int32()),
                 pa.array([np.unique(w).view(np.int64) for _, w in rows], pa.list_(pa.int64()))], names=["block", "length", "terms"])

    return written(items.select("block", "text").mapInArrow(run, "block int, length int, terms array<bigint>"), "item_terms")


def _statistics(terms: DataFrame, blocks: int) -> Iterator[Statistics]:
    """The statistics that each block's index needs, all counted over the items of all blocks."""
    whole = terms.agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest"), F.avg("length").alias("mean")).first()
    each = terms.select("block", F.explode("terms").alias("term"))
    n_items = written(each.groupBy("term").agg(F.count(F.lit(1)).alias("n_items")), "n_items")
    for k in range(blocks):
        mine = each.filter(F.col("block") == k).select("term").distinct().join(n_items, "term").toArrow()
        term = np.asarray(mine["term"].combine_chunks()).view(np.uint64)
        order = np.argsort(term)
        yield Statistics(whole["n"], whole["longest"] or 0, whole["mean"] or 0.0, term[order], np.asarray(mine["n_items"].combine_chunks())[order])


@dataclass
class Index:
    """Inverted index of some items. terms: sorted word hashes; per term its postings and bounds."""
    ids: list
    passage: int
    terms: np.ndarray
    bound: np.ndarray
    items: list[list[int]] = field(default_factory=list)
    impacts: list[list[float]] = field(default_factory=list)
    block_max: list[list[float]] = field(default_factory=list)
    parts: list[tuple[int, np.ndarray, int, np.ndarray]] = field(default_factory=list)
    n_blocks: int = 0
    block_at: np.ndarray | None = None
    block_of: np.ndarray | None = None
    block_bound: np.ndarray | None = None

    @classmethod
    def build(cls, rows: list[tuple[int, str]], stats: Statistics | None = None) -> Index:
        """stats: of all items, if the rows are some of them only."""
        found = sorted(((len(w), i, t, w) for i, t, w in ((i, t or "", _one(t or "")) for i, t in rows)), key=lambda x: x[:3])
        # items of like length have like impacts, so that the maxima of their blocks are tight
        rows, words = [(i, t) for _, i, t, _ in found], [w for *_, w in found]
        length = np.array([len(w) for w in words], dtype=float)
        n, longest, mean = len(rows), length.max() if len(rows) else 0, max(1.0, length.mean()) if len(rows) else 1.0
        counts = [np.unique(w, return_counts=True) for w in words]
        terms, n_items = np.unique(np.concatenate([c[0] for c in counts] or [np.zeros(0, np.uint64)]), return_counts=True)
        if stats is not None:
            n, longest, mean = stats.n, stats.longest, max(1.0, stats.mean)
            n_items = stats.n_items[np.searchsorted(stats.terms, terms)]
        idf = np.log1p((n - n_items + 0.5) / (n_items + 0.5))
        posted: list[list[tuple[int, float]]] = [[] for _ in terms]
        for k, (term, tf) in enumerate(counts):
            at = np.searchsorted(terms, term)
            impact = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[k] / mean))
            own = impact.sum()
            for t, x in zip(at.tolist(), (impact / own).tolist(), strict=True):
                posted[t].append((k, x))
        index = cls([i for i, _ in rows], int(max(PASSAGE_WORDS, longest)), terms,
                    np.array([max(x for _, x in p) for p in posted] or [], dtype=float))
        for p in posted:
            index.items.append([k for k, _ in p])
            index.impacts.append([x for _, x in p])
            index.block_max.append([max(x for _, x in p[a:a + BLOCK]) for a in range(0, len(p), BLOCK)])
        index._blocks(posted)
        for _, text in rows:
            q, a = (_one(x) for x in split_item(text))
            index.parts.append((min(NGRAM, len(q)), _grams(q), min(NGRAM, len(a)), _grams(a)))
        return index

    def _blocks(self, posted: list[list[tuple[int, float]]]) -> None:
        """The terms' maxima in blocks of ITEM_BLOCK neighbouring items, as sparse rows."""
        top = [{} for _ in posted]
        for t, p in enumerate(posted):
            for item, x in p:
                top[t][item // ITEM_BLOCK] = max(x, top[t].get(item // ITEM_BLOCK, 0.0))
        self.n_blocks = -(-len(self.ids) // ITEM_BLOCK)
        self.block_at = np.concatenate(([0], np.cumsum([len(x) for x in top]))).astype(np.int64)
        self.block_of = np.array([b for x in top for b in x], dtype=np.int64)
        self.block_bound = np.array([v for x in top for v in x.values()], dtype=float)

    def hopeful(self, group: np.ndarray, term: np.ndarray, threshold: float) -> np.ndarray:
        """Of the passages 0..n-1 (group, in order) with their distinct terms, those in which the maxima of some
        block of items reach the threshold; no other passage can have a hit."""
        if not len(group):
            return group
        n, out = int(group[-1]) + 1, []
        step = max(1, DENSE // max(1, self.n_blocks))
        for a in range(0, n, step):
            lo, hi = np.searchsorted(group, (a, a + step))
            t, size = term[lo:hi], np.diff(self.block_at)[term[lo:hi]]
            at = np.repeat(self.block_at[t] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            cell = np.repeat(group[lo:hi] - a, size) * self.n_blocks + self.block_of[at]
            m = min(step, n - a)
            sums = np.bincount(cell, weights=self.block_bound[at], minlength=m * self.n_blocks)
            out.append(a + np.flatnonzero(sums.reshape(m, self.n_blocks).max(axis=1) >= threshold - 1e-9))
        return np.concatenate(out)

    def search(self, query: list[int], threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: (item, score) of all items whose score with the query terms reaches the threshold."""
        least = threshold - 1e-9
        bound, found = self.bound, []
        at = [[self.items[t][0], 0, t] for t in query]  # current item, its position, the term
        while at:
            at.sort()
            total, pivot = 0.0, -1
            for k, (item, _, t) in enumerate(at):
                total += bound[t]
                if total >= least:
                    pivot, upto = item, k
                    break
            if pivot < 0:
                return found
            while upto + 1 < len(at) and at[upto + 1][0] == pivot:
                upto += 1
            # the pivot's blocks: their maxima bound all items up to the first block's end
            total, until = 0.0, at[upto + 1][0] if upto + 1 < len(at) else len(self.ids)
            for c in at[:upto + 1]:
                items, pos = self.items[c[2]], c[1]
                b = pos // BLOCK
                while b * BLOCK + BLOCK <= len(items) and items[b * BLOCK + BLOCK - 1] < pivot:
                    b += 1
                if b < len(self.block_max[c[2]]):
                    total += self.block_max[c[2]][b]
                    until = min(until, items[min(len(items), b * BLOCK + BLOCK) - 1] + 1)
            if total >= least:
                for c in at[:upto + 1]:
                    self._to(c, pivot)
                # summed exactly, so that passages with the same terms tie in whatever index
                score = math.fsum(self.impacts[c[2]][c[1]] for c in at[:upto + 1] if c[0] == pivot)
                if score >= least:
                    found.append((pivot, score))
                until = pivot + 1
            for c in at[:upto + 1]:
                self._to(c, max(until, pivot + 1))
            at = [c for c in at if c[0] >= 0]
        return found

    def _to(self, cursor: list[int], item: int) -> None:
        """Moves a cursor to its first posting from ``item`` on; -1 at its end."""
        if cursor[0] < 0:
            return
        items, pos = self.items[cursor[2]], cursor[1]
        while pos < len(items) and items[pos] < item:
            pos += 1
        cursor[0], cursor[1] = (items[pos], pos) if pos < len(items) else (-1, pos)

    def leaks(self, texts: pa.Array, threshold: float, question: float, answer: float) -> Iterator[tuple[int, int, float, float, float]]:
        """(row, item, best score, question overlap, answer overlap) of the verified hits."""
        if not len(self.terms):
            return
        half = self.passage // 2
        for first, last, words, head in word_hashes(texts):
            place = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
            at = np.flatnonzero(self.terms[place] == words)
            if not len(at):
                continue
            row = np.searchsorted(head, at, side="right") - 1
            # a word lies in the passage that begins in its half, and in the one before
            part = (at - head[row]) // half
            base = np.concatenate(([0], np.cumsum(np.diff(head) // half + 1)))
            mine = base[row] + part
            both = np.concatenate((mine, mine[part > 0] - 1))
            term = np.concatenate((place[at], place[at][part > 0]))
            pairs = np.unique(both * len(self.terms) + term)
            passage, term = pairs // len(self.terms), pairs % len(self.terms)
            begins = np.flatnonzero(np.diff(passage, prepend=-1))
            ends = np.append(begins[1:], len(passage))
            hopeful = np.flatnonzero(np.add.reduceat(self.bound[term], begins) >= threshold - 1e-9)
            size = (ends - begins)[hopeful]
            inside = np.repeat(begins[hopeful] - np.concatenate(([0], np.cumsum(size)[:-1]))[:len(size)], size) + np.arange(size.sum())
            hopeful = hopeful[self.hopeful(np.repeat(np.arange(len(hopeful)), size), term[inside], threshold)]
            best: dict[tuple[int, int], tuple[float, float, float]] = {}
            number = passage[begins[hopeful]]
            rows = np.searchsorted(base, number, side="right") - 1
            for k, p, r in zip(hopeful.tolist(), number.tolist(), rows.tolist(), strict=True):
                hits = self.search(term[begins[k]:ends[k]].tolist(), threshold)
                if not hits:
                    continue
                # an item that the passage holds in part lies within a passage's length around it
                start = int(head[r]) + (p - int(base[r])) * half
                near = words[max(int(head[r]), start - self.passage):min(int(head[r + 1]), start + 2 * self.passage)]
                grams = {n: np.unique(window_hashes(near, n)) for n in range(1, NGRAM + 1)}
                for item, score in hits:
                    nq, q, na, a = self.parts[item]
                    share = [float(np.isin(g, grams[n], assume_unique=True).mean()) if len(g) else 1.0 for n, g in ((nq, q), (na, a))]
                    if share[0] >= question and share[1] >= answer:
                        best[r, item] = max((score, *share), best.get((r, item), (0.0, 0.0, 0.0)))
            for (r, item), found in sorted(best.items()):
                yield first + r, item, *found


def with_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION_OVERLAP,
               answer: float = ANSWER_OVERLAP, leaks_col: str = "leaks") -> DataFrame:
    """Every input row and column, plus ``leaks`` (or another name): array of (item_id, score, question_overlap, answer_overlap).

    ``leaks`` (replaced if the input has it) lists by item the benchmark items that some place
    of the whole text holds: score (best passage, 0 to 1) >= threshold, and shares of the
    question's and answer's word n-grams, within a passage's length around, >= their limits. Upper and lower case and punctuation do not count.
    Null and empty texts, and all texts if the benchmark is empty, have an empty list;
    items with null id or without words match nothing; repeated item ids are merged by the
    best score; rows with null or repeated doc_id are judged like all others.

    Items are read to the driver in indexes of about ``MAX_ITEMS`` items at most (by hash of
    the item_id), each broadcast; all have the BM25 statistics and the passage length of the
    whole benchmark, so scores do not depend on their number; every text is searched in all.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter(
        "item_id IS NOT NULL AND text IS NOT NULL").distinct()
    blocks = max(1, -(-items.count() // MAX_ITEMS))
    spark = docs.sparkSession
    kind = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double>>"
    found: list[Column] = []
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    whole = iter([None]) if blocks == 1 else _statistics(_item_terms(items), blocks)
    for k, stats in enumerate(whole):
        rows = items.filter(F.col("block") == k).collect()
        index = spark.sparkContext.broadcast(Index.build([(r["item_id"], r["text"]) for r in rows if r["text"].strip()], stats))
        found.append(_search_udf(index, threshold, question, answer, kind)(F.col("text").cast("string")))
    merged = found[0] if blocks == 1 else F.sort_array(F.concat(*found))
    return docs.drop(leaks_col).withColumn(leaks_col, merged)


def _search_udf(index, threshold: float, question: float, answer: float, kind: str):
    def search(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            out: list[dict[int, tuple]] = [{} for _ in range(len(text))]
            for row, item, *rest in index.value.leaks(text, threshold, question, answer):
                i = index.value.ids[item]
                out[row][i] = max(out[row].get(i, (0.0,)), tuple(rest))
            yield pa.array([[{"item_id": i, "score": s, "question_overlap": q, "answer_overlap": a} for i, (s, q, a) in sorted(x.items())] for x in out],
                           pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])))
    search.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(search, kind)


def find_leaks(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of each leak; see with_leaks."""
    return (with_leaks(docs.select("doc_id", "text"), benchmark, **limits)
            .select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*"))
