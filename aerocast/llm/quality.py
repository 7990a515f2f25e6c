"""Quality classifier by co-training of two views (operator 4).

One logistic classifier sees the text (word presence and shape statistics), the other
the page metadata (language, source, length). Over some rounds each one labels all
unlabelled documents it is confident about and hands them to the *other* one's training
set. Both views are then calibrated on held-out labelled documents and combined, and the
combination scores every document.

Of the labelled documents a bounded sample goes to the driver, at most ``MAX_LABELLED``,
chosen by a hash of doc_id. The unlabelled ones are all used and stay on the executors,
as a table with a packed record each: a task labels its records anew from the models of
the rounds before and sends sums of fixed size. Scoring runs in Arrow batches over all
documents and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerocast.llm.common import FEW_BYTES, LOWER, large_binaries, let_go, mix, slices, span_hashes, spare, word_spans, written

#: Bound of the labelled sample that the fit sees.
MAX_LABELLED = 20_000
#: Words are hashed to so many features, of which those with the strongest evidence are used.
HASH_BITS, MAX_WORDS, MIN_DOCS, MIN_Z = 18, 384, 8, 4.0
ROUNDS, CONFIDENT = 3, 0.97
#: Newton steps of a fit; records that a task holds unpacked; numbers in a piece of a task's sums.
STEPS, BLOCK, PIECE = 12, 2048, 1 << 13
HELD_OUT = 0.25
METADATA = ("lang", "source", "n_chars")
META_DIM = 32

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
#: The kind of a byte, from 1; 0: none of them.
_KINDS = (range(ord("A"), ord("Z") + 1), range(ord("0"), ord("9") + 1), b"!?", b"|", b"*#$%&@^~=+<>", b".,;:", b"\n")
_KIND = np.zeros(256, dtype=np.uint8)
for _k, _bytes in enumerate(_KINDS, 1):
    _KIND[list(_bytes)] = _k
N_STATS = len(_KINDS) + 6


def _distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, ascending; by a sort, which is faster than NumPy's hash table."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def text_features(texts: pa.LargeBinaryArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, statistics, row of each word feature, word feature), features distinct in a row."""
    for first, last, data, offsets in slices(texts, FEW_BYTES):
        n = last - first
        size = np.diff(offsets).astype(float)
        each = np.maximum(size, 1.0)
        starts, ends, head = word_spans(data, offsets)
        words = np.diff(head).astype(float)
        some = np.maximum(words, 1.0)
        row = np.repeat(np.arange(n), np.diff(head))
        exact = span_hashes(data, starts, ends)
        same = np.zeros(len(starts) + 1)
        if len(starts) > 1:
            same[2:] = np.cumsum((exact[1:] == exact[:-1]) & (row[1:] == row[:-1]))
        number = np.asarray(pa.array(exact).dictionary_encode().indices).astype(np.int64)
        distinct = np.bincount(_distinct(row << 32 | number) >> 32, minlength=n)
        kind = _KIND[data]
        special = np.flatnonzero(kind)
        kind = kind[special]
        stats = [np.diff(np.searchsorted(special[kind == k], offsets)) / each for k in range(1, len(_KINDS) + 1)]
        stats += [np.log1p(words), size / some, distinct / some, (same[head[1:]] - same[np.minimum(head[:-1] + 1, head[1:])]) / some,
                  (words == 0).astype(float), np.log1p(some / (1.0 + stats[-1] * each))]
        low = LOWER[data]
        solid = _LETTER[low]
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        inner = offsets[1:-1]
        inner = inner[inner < len(data)]
        begin[inner] = solid[inner]
        stop = solid.copy()
        stop[:-1] &= ~solid[1:]
        edge = inner[inner > 0] - 1
        stop[edge] = solid[edge]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        head = np.searchsorted(starts, offsets)
        row = np.repeat(np.arange(n, dtype=np.uint64), np.diff(head))
        feature = span_hashes(low, starts, ends) >> np.uint64(64 - HASH_BITS)
        pairs = _distinct(row << np.uint64(HASH_BITS) | feature)
        yield first, last, np.stack(stats, axis=1), (pairs >> np.uint64(HASH_BITS)).astype(np.int64), (pairs & np.uint64((1 << HASH_BITS) - 1)).astype(np.int64)


def metadata_features(lang: list, source: list, n_chars: list) -> np.ndarray:
    """Hashed language and source, and the logarithm of the length."""
    import zlib
    out = np.zeros((len(lang), META_DIM + 1))
    for k, (a, b, c) in enumerate(zip(lang, source, n_chars, strict=True)):
        for value in (f"lang={a}", f"source={b}"):
            out[k, zlib.crc32(value.encode()) % META_DIM] = 1.0
        out[k, META_DIM] = np.log1p(max(0.0, float(c or 0)))
    return out


@dataclass
class Logistic:
    """Ridge logistic regression on standardised features."""
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 3.0, steps: int = 12) -> Logistic:
        mean, scale = x.mean(axis=0, dtype=float), x.std(axis=0, dtype=float)
        scale = np.where(scale > 1e-9, scale, 1.0)
        z = np.ones((x.shape[0], x.shape[1] + 1), dtype=np.float32)
        np.subtract(x, mean, out=z[:, :-1], casting="same_kind")
        z[:, :-1] /= scale.astype(np.float32)
        w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[-1] = 1e-3
        loss = lambda w: np.logaddexp(0, -(2 * y - 1) * (z @ w)).sum() + (penalty * w * w).sum() / 2
        now = loss(w)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-z @ w))
            gradient = z.T @ (p - y) + penalty * w
            curve, hessian = np.maximum(p * (1 - p), 1e-5), np.diag(penalty)
            for at in range(0, len(z), 2048):  # in blocks, to hold no second copy of the features
                part = z[at:at + 2048].astype(float)
                hessian = hessian + (part * curve[at:at + 2048, None]).T @ part
            step = np.linalg.solve(hessian, gradient)
            rate = 1.0
            while rate > 1e-4 and loss(w - rate * step) > now:
                rate /= 2
            w = w - rate * step
            before, now = now, loss(w)
            if before - now < 1e-6 * before:
                break
        return cls(mean, scale, w[:-1], float(w[-1]))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias


@dataclass
class QualityModel:
    """Both views and their calibrated combination; None as text: every document is good."""
    words: np.ndarray
    text: Logistic | None
    meta: Logistic | None
    combine: Logistic | None

    def score(self, text_x: np.ndarray, meta_x: np.ndarray) -> np.ndarray:
        views = np.column_stack((self.text.logit(text_x), self.meta.logit(meta_x)))
        return 1 / (1 + np.exp(-self.combine.logit(views)))


def _columns(docs: DataFrame) -> list:
    """Key and metadata columns by position (a missing one is null)."""
    have = lambda c, kind: F.col(c).cast(kind) if c in docs.columns else F.lit(None).cast(kind)
    return [have("lang", "string"), have("source", "string"), have("n_chars", "double"), F.col("text").cast("string")]


def labels_of(labels: DataFrame) -> DataFrame:
    """(doc_id, good): good 1 if every label row of the document has quality 1 and is not toxic, 0 if one says
    otherwise; rows without doc_id or without any verdict are no labels."""
    bad = (F.col("quality") == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    return (labels.filter(F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | (F.col("toxic") == 1)))
            .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
            .agg(F.min(F.when(F.coalesce(bad, F.lit(False)), 0).otherwise(1)).alias("good")))


def _sampled(docs: DataFrame, ids: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of the documents of a bounded sample: doc_id, label, statistics, metadata, and row and number of the words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            meta = metadata_features(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist())
            for first, last, stats, row, feature in text_features(large_binaries(b.column(5))):
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(last - first + 1)), pa.int32()), pa.array(feature.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, last - first), b.column(1).slice(first, last - first), pa.array(list(stats)), pa.array(list(meta[first:last])), lists],
                    names=["doc_id", "good", "stats", "meta", "words"])

    picked = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(f"c{k}") for k, c in enumerate(_columns(docs))])
              .join(F.broadcast(ids), "doc_id").select("doc_id", "good", "c0", "c1", "c2", "c3"))
    got = picked.mapInArrow(spare(run), "doc_id long, good int, stats array<double>, meta array<double>, words array<int>").toArrow().combine_chunks()
    n = len(got)
    if not n:
        return (np.zeros(0, np.int64), np.zeros(0), np.zeros((0, N_STATS)), np.zeros((0, META_DIM + 1)), np.zeros(0, np.int64), np.zeros(0, np.int64))
    flat = lambda c: np.asarray(pa.concat_arrays([x.flatten() for x in got[c].chunks]))
    sizes = np.asarray(got["words"].combine_chunks().value_lengths()) if n else []
    row, word = np.repeat(np.arange(n, dtype=np.int32), sizes), flat("words")
    ids_, stats = np.asarray(got["doc_id"]), flat("stats").reshape(n, -1)
    # one order whatever task a document came from
    order = np.lexsort((np.bincount(row, weights=word, minlength=n), stats[:, 0], ids_))
    rank = np.empty(n, dtype=np.int32)
    rank[order] = np.arange(n)
    row = rank[row]
    by = np.lexsort((word, row))
    return (ids_[order], np.asarray(got["good"])[order].astype(float), stats[order], flat("meta").reshape(n, -1)[order], row[by], word[by])


def _select_words(row: np.ndarray, word: np.ndarray, y: np.ndarray, rate: float) -> np.ndarray:
    """Word features whose presence changes the odds of being good most surely."""
    dim = 1 << HASH_BITS
    n = np.bincount(word, minlength=dim).astype(float)
    good = np.bincount(word, weights=y[row], minlength=dim)
    z = np.abs(good - n * rate) / np.sqrt(np.maximum(n * rate * (1 - rate), 1e-9))
    usable = np.flatnonzero((n >= MIN_DOCS) & (z >= MIN_Z))
    return np.sort(usable[np.argsort(-z[usable], kind="stable")][:MAX_WORDS])


def _matrix(stats: np.ndarray, row: np.ndarray, word: np.ndarray, words: np.ndarray) -> np.ndarray:
    x = np.zeros((len(stats), stats.shape[1] + len(words)), dtype=np.float32)
    x[:, :stats.shape[1]] = stats
    if len(words):
        at = np.minimum(np.searchsorted(words, word), len(words) - 1)
        hit = words[at] == word
        x[row[hit], stats.shape[1] + at[hit]] = 1.0
    return x


def _packed(stats: np.ndarray, meta: np.ndarray, row: np.ndarray, word: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A record of fixed size (bytes) per document: statistics and length as floats, metadata flags and words as bits."""
    floats = np.column_stack((stats, meta[:, META_DIM])).astype("<f4")
    bits = np.concatenate((meta[:, :META_DIM] > 0, _matrix(np.zeros((len(stats), 0)), row, word, words) > 0), axis=1)
    return np.concatenate((floats.view(np.uint8), np.packbits(bits, axis=1)), axis=1)


def _unpacked(records: np.ndarray, n_words: int) -> list[np.ndarray]:
    """The features of the text and the metadata view."""
    cut = 4 * (N_STATS + 1)
    floats = np.ascontiguousarray(records[:, :cut]).view("<f4")
    bits = np.unpackbits(records[:, cut:], axis=1, count=META_DIM + n_words)
    return [np.concatenate((floats[:, :N_STATS], bits[:, META_DIM:]), axis=1, dtype=float),
            np.concatenate((bits[:, :META_DIM], floats[:, N_STATS:]), axis=1, dtype=float)]


def pool_table(docs: DataFrame, good: DataFrame, words: np.ndarray) -> DataFrame:
    """A record of each row whose doc_id has no label, written to the shared folder; null doc_ids are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            meta = metadata_features(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())
            for first, last, stats, row, word in text_features(large_binaries(b.column(4))):
                records = _packed(stats, meta[first:last], row, word, words)
                offsets = np.arange(len(records) + 1, dtype=np.int32) * records.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, last - first), pa.Array.from_buffers(pa.binary(), len(records), [None, pa.py_buffer(offsets), pa.py_buffer(records.tobytes())])],
                    names=["doc_id", "record"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(f"c{k}") for k, c in enumerate(_columns(docs))]).filter("doc_id IS NOT NULL")
    records = rows.mapInArrow(spare(run), "doc_id long, record binary")
    return written(records.join(good.select("doc_id"), "doc_id", "left_anti").select("record"), "pool")


def taught(views: list[np.ndarray], rounds: list[list[Logistic]]) -> list[np.ndarray]:
    """The pseudo-label of each document in the training set of each view (-1: none), from the first round in which
    the other view's model was confident."""
    labels = [np.full(len(x), -1.0) for x in views]
    for models in rounds:
        for k, (model, x) in enumerate(zip(models, views, strict=True)):
            p, new = 1 / (1 + np.exp(-model.logit(x))), labels[1 - k] < 0
            labels[1 - k][new & (p >= CONFIDENT)] = 1.0
            labels[1 - k][new & (1 - p >= CONFIDENT)] = 0.0
    return labels


def _moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number, sums and sums of squares of the bad, then of the good ones."""
    return np.concatenate([np.concatenate(([len(p)], p.sum(axis=0), (p * p).sum(axis=0))) for p in (x[y == 0], x[y == 1])])


def _newton(x: np.ndarray, y: np.ndarray, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Loss, gradient and Hessian of the logistic loss; weight: of a bad and of a good document."""
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    each, at = weight[y.astype(int)], z @ w
    p = 1 / (1 + np.exp(-at))
    loss = (each * np.logaddexp(0, -(2 * y - 1) * at)).sum()
    hessian = (z * (each * np.maximum(p * (1 - p), 1e-5))[:, None]).T @ z
    return np.concatenate(([loss], z.T @ (each * (p - y)), hessian.ravel()))


def _pool_sums(pool: DataFrame, n_words: int, rounds: list[list[Logistic]], asks: list) -> list[np.ndarray | float]:
    """Sums over all records, by view: of an ask () the moments, of one with arguments those of ``_newton``, of None
    nothing. Tasks send their sums in pieces, which the executors add up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        from pyspark import TaskContext
        sums = [0.0, 0.0]
        for b in batches:
            if not b.num_rows:
                continue
            records = np.frombuffer(b"".join(b.column(0).to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1)
            for a in range(0, len(records), BLOCK):
                views = _unpacked(records[a:a + BLOCK], n_words)
                for k, (x, y, ask) in enumerate(zip(views, taught(views, rounds), asks, strict=True)):
                    if ask is not None:
                        x, y = x[y >= 0], y[y >= 0]
                        sums[k] = sums[k] + (_newton(x, y, *ask) if ask else _moments(x, y))
        for k, s in enumerate(sums):
            if isinstance(s, np.ndarray):
                pieces = [s[a:a + PIECE].tobytes() for a in range(0, len(s), PIECE)]
                n = len(pieces)
                yield pa.RecordBatch.from_arrays([pa.array([k] * n, pa.int32()), pa.array(range(n), pa.int32()),
                                                  pa.array([TaskContext.get().partitionId()] * n, pa.int32()), pa.array(pieces, pa.binary())],
                                                 names=["view", "piece", "task", "sums"])

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")
        total = sum(np.frombuffer(s) for s in table.column("sums").to_pylist())
        return table.slice(0, 1).select(["view", "piece"]).append_column("sums", pa.array([total.tobytes()], pa.binary()))

    parts = pool.mapInArrow(run, "view int, piece int, task int, sums binary")
    rows = parts.groupBy("view", "piece").applyInArrow(add, "view int, piece int, sums binary").collect()
    found: list[np.ndarray | float] = [0.0, 0.0]
    for k in range(2):
        pieces = [r["sums"] for r in sorted((r for r in rows if r["view"] == k), key=lambda r: r["piece"])]
        if pieces:
            found[k] = np.frombuffer(b"".join(pieces))
    return found


def _fit_views(views: list[np.ndarray], y: np.ndarray, pool: DataFrame, n_words: int, rounds: list[list[Logistic]]) -> list[Logistic]:
    """Fits both views to the labelled documents (on the driver) and those taught in the rounds so far (by Spark jobs).
    The taught documents of a class weigh together at most as much as its labelled ones, so that the label rate stays."""
    def total(asks: list) -> list:
        return _pool_sums(pool, n_words, rounds, asks) if rounds else [0.0, 0.0]

    def near(x: np.ndarray, f) -> np.ndarray:
        return sum(f(x[a:a + BLOCK].astype(float), y[a:a + BLOCK]) for a in range(0, len(x), BLOCK))

    fits = []
    for k, (x, far) in enumerate(zip(views, total([(), ()]), strict=True)):
        d = x.shape[1]
        here = near(x, _moments).reshape(2, -1)
        there = np.zeros_like(here) + (far.reshape(2, -1) if isinstance(far, np.ndarray) else 0.0)
        weight = np.minimum(1.0, here[:, 0] / np.maximum(there[:, 0], 1.0))
        n, first, second = np.split((here + weight[:, None] * there).sum(axis=0), (1, 1 + d))
        mean = first / n
        scale = np.sqrt(np.maximum(second / n - mean * mean, 0.0))
        scale = np.where(scale > 1e-6, scale, 1.0)
        w = np.zeros(d + 1)
        if rounds:  # from the weights of the round before
            last = rounds[-1][k]
            w = np.append(last.weights * scale / last.scale, last.bias + (last.weights * (mean - last.mean) / last.scale).sum())
        fits.append({"mean": mean, "scale": scale, "weight": weight, "w": w, "trial": w, "step": None, "rate": 1.0, "now": np.inf, "left": STEPS, "done": False})
    ridge = [np.append(np.full(x.shape[1], 3.0), 1e-3) for x in views]
    while not all(f["done"] for f in fits):
        sums = total([None if f["done"] else (f["mean"], f["scale"], f["trial"], f["weight"]) for f in fits])
        for f, x, far, penalty in zip(fits, views, sums, ridge, strict=True):
            if f["done"]:
                continue
            w, n = f["trial"], x.shape[1] + 1
            found = near(x, lambda part, of, f=f, w=w: _newton(part, of, f["mean"], f["scale"], w, np.ones(2))) + far
            loss = found[0] + (penalty * w * w).sum() / 2
            if loss > f["now"]:
                f["rate"] /= 2
                f["trial"], f["done"] = f["w"] - f["rate"] * f["step"], f["rate"] < 1e-4
                continue
            f["done"] = f["left"] == 0 or f["now"] - loss < 1e-6 * f["now"] < np.inf
            f["w"], f["now"], f["left"], f["rate"] = w, loss, f["left"] - 1, 1.0
            f["step"] = np.linalg.solve(found[1 + n:].reshape(n, n) + np.diag(penalty), found[1:1 + n] + penalty * w)
            f["trial"] = w - f["step"]
    return [Logistic(f["mean"], f["scale"], f["w"][:-1], float(f["w"][-1])) for f in fits]


def fit_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> QualityModel:
    """Co-trains the two views on the labels (doc_id, quality and toxic) and all documents without one."""
    good = labels_of(labels)
    chosen = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).withColumn("good", F.col("good").cast("int"))
    ids, y, stats, meta, row, word = _sampled(docs, chosen)
    if len(y) < 8 or y.min() == y.max():
        return QualityModel(np.zeros(0, np.int64), None, None, None)
    held = mix(ids.astype(np.uint64)) < np.uint64(int(HELD_OUT * 2**64))
    train = ~held
    if train.sum() < 8 or y[train].min() == y[train].max() or not held.any() or y[held].min() == y[held].max():
        train = held = np.ones(len(y), dtype=bool)
    use = train[row]
    words = _select_words(row[use], word[use], y, float(y[train].mean()))
    views = [_matrix(stats, row, word, words), meta]
    del row, word, use
    pool = pool_table(docs, good, words)
    rounds: list[list[Logistic]] = []
    for _ in range(ROUNDS + 1):
        models = _fit_views([x[train] for x in views], y[train], pool, len(words), rounds)
        rounds.append(models)
    logits = np.column_stack([m.logit(x[held]) for m, x in zip(models, views, strict=True)])
    return QualityModel(words, models[0], models[1], Logistic.fit(logits, y[held], ridge=1.0))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, score_col: str = "quality_score",
                  keep_col: str = "quality_keep", **bounds) -> DataFrame:
    """Scores all documents; every input column, plus quality_score and quality_keep (or other names).

    ``quality_score`` is the combined probability of being good (quality 1 and not toxic),
    ``quality_keep`` is score >= threshold; input columns of these two names are replaced.
    Null texts score as empty ones, null metadata as a value of its own, null doc_ids and
    repeated rows are scored like all others; missing metadata columns count as null. If
    there are too few labels, or all are alike, every score is 1. Empty tables give an
    empty result.
    """
    docs = docs.drop(score_col, keep_col)
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, **bounds))

    def run(batches: Iterator[tuple]) -> Iterator[pa.Array]:
        m = model.value
        for lang, source, n_chars, text in batches:
            if m.text is None:
                yield pa.array(np.ones(len(text)))
                continue
            meta = metadata_features(lang.to_pylist(), source.to_pylist(), n_chars.to_pylist())
            out = np.zeros(len(text))
            for first, last, stats, row, word in text_features(large_binaries(text)):
                out[first:last] = m.score(_matrix(stats, row, word, m.words), meta[first:last])
            yield pa.array(out)

    score = F.arrow_udf(_typed(run), T.DoubleType())
    return docs.withColumn(score_col, score(*_columns(docs))).withColumn(keep_col, F.col(score_col) >= threshold)


def _typed(run):
    task = spare(run)

    def scores(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return task(batches)
    scores.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return scores
