"""Phrase collocation mining by set-oriented joins of occurrence relations (operator 13).

An occurrence relation of length k says which frequent phrase of k words begins at which
place of which piece. It is kept as one row per *chunk* (some MB of text of one
language), sorted by piece and place: packed arrays of places and phrase ids. Level by
level, in the manner of SETM:

1. *merge-join*: within a chunk, phrases at neighbouring places of a piece are joined to
   phrases one word longer (a phrase of k + 1 words can only be frequent where both its
   phrases of k words are);
2. *group-count*: a chunk gives one row per distinct phrase, with its count; these rows
   are shuffled and sorted by phrase and summed in one pass, so a phrase that a third of
   all pieces hold is one row a chunk;
3. *semi-join*: the rows of frequent phrases go back to their chunks with the phrase's
   new id, and all other occurrences are dropped before the next level.

Words are compared as bytes and phrases as (id of all words but the last, id of the last),
so nothing rests on hashes. The relations of words and of phrases of three words and more,
and the frequent groups of each chunk and length, are tables in the shared folder; pairs,
the largest, are joined once for counting and once again for the next length. Phrases
are spelt out, cut and scored in SQL at the end, over the frequent ones only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerocast.llm.common import LOWER, large_binaries, written

#: Bytes of text in a chunk (a longer text is a chunk of its own).
CHUNK_BYTES = 8 << 20
#: Rows of a batch that goes back to Spark; frequent rows that a task holds before it deals them out by chunk.
ROWS, HELD_ROWS = 50_000, 1 << 20

_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, 0x09]] = True
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True

WORDS_DDL = "chunk long, codes binary, words array<struct<code: int, word: binary, n: int>>"
PAIRS_DDL = "chunk long, head long, last long, n int"
LEVEL_DDL = "chunk long, heads binary, lasts binary, places binary, groups array<struct<head: long, last: long, n: int>>"
#: The frequent keys of a level, once each (chunk -1), and those of each chunk: packed numbers, words only in the former.
KNOWN_DDL = "chunk long, k int, a binary, b binary, id binary, f binary, words array<binary>"


# ------------------------------------------------------------------ in a chunk
def piece_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, number of the piece) of the words of lower-cased bytes; pieces end with rows."""
    broken = _BREAK[data]
    solid = ~(broken | _GAP[data])
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    piece = np.cumsum(broken, dtype=np.int32)[starts] + np.searchsorted(inner, starts, side="right").astype(np.int32)
    return starts, ends, piece


def coded_words(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of the words in order, with -1 wherever a piece ends; the words of the codes; their counts."""
    data = LOWER[np.frombuffer(b"".join(texts), np.uint8)]
    starts, ends, piece = piece_words(data, np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64))
    if not len(starts):
        return np.zeros(0, np.int32), pa.array([], pa.large_binary()), np.zeros(0, np.int64)
    size = ends - starts
    where = np.concatenate(([0], np.cumsum(size)))
    solid = data[np.repeat(starts - where[:-1], size) + np.arange(where[-1])]
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(where), pa.py_buffer(solid)]).dictionary_encode()
    codes = np.asarray(found.indices).astype(np.int32)
    new = np.flatnonzero(np.diff(piece)) + 1
    return np.insert(codes, new, -1), found.dictionary, np.bincount(codes, minlength=len(found.dictionary))


def packed(x: np.ndarray) -> bytes:
    """Compressed by byte planes: the high bytes of ids are nearly all alike."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 1)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each occurs."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[at], np.diff(np.append(at, len(keys))).astype(np.int32)


def numbers(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of each of x in the sorted distinct ``known``, -1 for others."""
    if not len(known):
        return np.full(len(x), -1, np.int64)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return np.where(known[at] == x, at, -1)


class Chunk:
    """Frequent words of a chunk's places by number in their sorted ids; -1 for other words and where a piece ends."""

    def __init__(self, codes: np.ndarray, code: np.ndarray, word_id: np.ndarray):
        self.ids = np.sort(word_id)
        number = np.full(int(codes.max(initial=0)) + 2, -1, np.int32)  # the last is for -1
        number[code] = np.searchsorted(self.ids, word_id)
        self.words = number[codes]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Places at which two frequent words of a piece stand, and the pairs' keys."""
        at = np.flatnonzero((self.words[:-1] >= 0) & (self.words[1:] >= 0)) if len(self.words) else np.zeros(0, np.int64)
        return at, self.words[at].astype(np.int64) * len(self.ids) + self.words[at + 1]

    def split(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.ids[keys // len(self.ids)], self.ids[keys % len(self.ids)]

    def key_of(self, heads: np.ndarray, lasts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, heads) * len(self.ids) + np.searchsorted(self.ids, lasts)


def level_row(chunk: int, heads: np.ndarray, lasts: np.ndarray, places: np.ndarray) -> pa.Table:
    """An occurrence relation not yet filtered, with its groups: phrase (head, last) begins at place."""
    a, b = np.unique(heads), np.unique(lasts)
    keys, n = grouped(np.searchsorted(a, heads) * max(1, len(b)) + np.searchsorted(b, lasts))
    groups = pa.StructArray.from_arrays([pa.array(a[keys // max(1, len(b))]), pa.array(b[keys % max(1, len(b))]), pa.array(n)], names=["head", "last", "n"])
    return pa.table({"chunk": pa.array([chunk], pa.int64()), **{k: pa.array([packed(x)], pa.binary()) for k, x in (("heads", heads), ("lasts", lasts), ("places", places))},
                     "groups": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), groups)})


def extended(chunk: int, ids: np.ndarray, lasts: np.ndarray, places: np.ndarray) -> pa.Table:
    """Level k + 1 from the frequent occurrences of level k in order of place: phrases at neighbouring places (places of
    two pieces are never neighbours) make a longer one, whose head is the first and whose last word is the second's."""
    at = np.flatnonzero(np.diff(places) == 1)
    return level_row(chunk, ids[at], lasts[at + 1], places[at])


def _column(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(table.column(name))


def known_of(table: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, id) of a chunk's frequent keys of level k."""
    rows = table.filter(pa.array(_column(table, "k") == k)) if table.num_rows else table
    return tuple(np.concatenate([np.zeros(0, np.int64), *(unpacked(x.as_py(), np.int64) for x in rows.column(c))]) for c in ("a", "b", "id"))


def count_pairs(mine: pa.Table, known: pa.Table) -> pa.Table:
    """Chunk with its codes, frequent words (a = code, id) -> its pairs with their counts."""
    out, (code, _, word_id) = [], known_of(known, 1)
    for chunk, codes in zip(mine.column("chunk").to_pylist(), mine.column("codes"), strict=True):
        here = Chunk(unpacked(codes.as_py(), np.int32), code, word_id)
        keys, n = grouped(here.pairs()[1])
        for at in range(0, len(keys), ROWS):
            heads, lasts = here.split(keys[at:at + ROWS])
            out.append(pa.record_batch([pa.array(np.full(len(heads), chunk)), pa.array(heads), pa.array(lasts), pa.array(n[at:at + ROWS])], names=["chunk", "head", "last", "n"]))
    schema = pa.schema([("chunk", pa.int64()), ("head", pa.int64()), ("last", pa.int64()), ("n", pa.int32())])
    return pa.Table.from_batches(out, schema)


def none_of_level() -> pa.Table:
    return level_row(0, *(np.zeros(0, np.int64),) * 2, np.zeros(0, np.int32)).slice(0, 0)


def extend_pairs(mine: pa.Table, known: pa.Table) -> pa.Table:
    """Chunk with its codes, frequent words (k = 1, a = code, id) and pairs (k = 2, a = head, b = last, id) -> level 3."""
    out, (code, _, word_id), (head, last, pair_id) = [], known_of(known, 1), known_of(known, 2)
    for chunk, codes in zip(mine.column("chunk").to_pylist(), mine.column("codes"), strict=True):
        here = Chunk(unpacked(codes.as_py(), np.int32), code, word_id)
        places, keys = here.pairs()
        frequent_keys = here.key_of(head, last)
        order = np.argsort(frequent_keys)
        found = numbers(frequent_keys[order], keys)
        at = np.flatnonzero(found >= 0)
        out.append(extended(chunk, pair_id[order][found[at]], here.ids[here.words[places[at] + 1]], places[at].astype(np.int32)))
    return pa.concat_tables(out) if out else none_of_level()


def extend_phrases(mine: pa.Table, known: pa.Table) -> pa.Table:
    """Level k of a chunk, not yet filtered, and its frequent phrases (a = head, b = last, id) -> level k + 1."""
    out = []
    for row in mine.to_pylist():
        head, last, ids = known_of(known, row["k"])
        heads, lasts, places = (unpacked(row[c], t) for c, t in (("heads", np.int64), ("lasts", np.int64), ("places", np.int32)))
        a, b = np.unique(heads), np.unique(lasts)
        key = np.searchsorted(a, head) * len(b) + np.searchsorted(b, last)  # every known phrase occurs here
        order = np.argsort(key)
        found = numbers(key[order], np.searchsorted(a, heads) * len(b) + np.searchsorted(b, lasts))
        at = np.flatnonzero(found >= 0)
        out.append(extended(row["chunk"], ids[order][found[at]], lasts[at], places[at]))
    return pa.concat_tables(out) if out else none_of_level()


# ------------------------------------------------------------------ relations
def occurrences(docs: DataFrame, text_col: str, lang_col: str, chunk_bytes: int) -> DataFrame:
    """The relation of length 1: chunks of one language each, with their words (as "language word") and counts. Chunks
    are numbered by task and turn."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[bytes]] = {}
        held: dict[str, int] = {}
        task, turn = TaskContext.get().partitionId(), 0

        def row(lang: str) -> pa.RecordBatch:
            nonlocal turn
            codes, words, n = coded_words(waiting.pop(lang))
            held.pop(lang)
            turn += 1
            words = pc.binary_join_element_wise(pa.scalar(lang.encode(), pa.large_binary()), words, pa.scalar(b" ", pa.large_binary())).cast(pa.binary())
            items = pa.StructArray.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), words, pa.array(n.astype(np.int32))], names=["code", "word", "n"])
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | turn], pa.int64()), pa.array([packed(codes)], pa.binary()),
                                               pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), items)], names=["chunk", "codes", "words"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), large_binaries(batch.column(1)), strict=True):
                text = text.as_py()
                if text:
                    if held.get(lang, 0) and held[lang] + len(text) > chunk_bytes:
                        yield row(lang)
                    waiting.setdefault(lang, []).append(text)
                    held[lang] = held.get(lang, 0) + len(text)
                    if sum(held.values()) > 2 * chunk_bytes:  # many languages: the fullest goes
                        yield row(max(held, key=held.get))
        for lang in list(waiting):
            yield row(lang)

    return rows.mapInArrow(run, WORDS_DDL)


def frequent(groups: DataFrame, keys: list[str], level: int, least: int) -> DataFrame:
    """The keys that occur ``least`` times in all, with their sum f and a number, and the rows of them by chunk.

    ``groups``: (chunk, code, word, n) or (chunk, head, last, n). Rows are shuffled and sorted by key; a pass over them
    holds the rows of one key (one a chunk) and up to HELD_ROWS frequent rows, packed by chunk when they go."""
    rows = groups.repartition(*keys).sortWithinPartitions(*keys)
    first, second = ("code", None) if level == 1 else ("head", "last")
    schema = pa.schema([("chunk", pa.int64()), ("k", pa.int32()), *((c, pa.binary()) for c in ("a", "b", "id", "f")), ("words", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ordinal = TaskContext.get().partitionId(), 0
        waiting: list[pa.RecordBatch] = []  # rows of the last key so far
        held: list[tuple[np.ndarray, ...]] = []  # chunk, a, b, id

        def row(chunk: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray, f: np.ndarray | None = None, words: list | None = None) -> list:
            return [chunk, level, packed(a), packed(b), packed(ids), None if f is None else packed(f), words]

        def dealt() -> Iterator[pa.RecordBatch]:
            """What is held, a row for each chunk."""
            if held:
                chunk, *columns = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                order = np.argsort(chunk, kind="stable")
                chunk, columns = chunk[order], [x[order] for x in columns]
                at = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1])))
                out = [row(int(chunk[i]), *(x[i:j] for x in columns)) for i, j in zip(at, np.append(at[1:], len(chunk)), strict=True)]
                for i in range(0, len(out), 100):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[i:i + 100], strict=True), schema.types, strict=True)], schema=schema)

        def whole(table: pa.Table, start: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Rows of whole keys; start: the first row of each key."""
            nonlocal ordinal
            sums = np.add.reduceat(_column(table, "n").astype(np.int64), start)
            many = np.diff(np.append(start, table.num_rows))
            hit = sums >= least
            if hit.any():
                ids = (ordinal + np.arange(int(hit.sum()), dtype=np.int64)) << 22 | task
                ordinal += len(ids)
                a = _column(table, first).astype(np.int64)
                b = np.zeros(len(a), np.int64) if second is None else _column(table, second)
                words = table.column("word").take(pa.array(start[hit])).to_pylist() if second is None else None
                one = row(-1, a[start[hit]], b[start[hit]], ids, sums[hit], words)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(one, schema.types, strict=True)], schema=schema)
                mine = np.repeat(hit, many)
                held.append((_column(table, "chunk")[mine], a[mine], b[mine], np.repeat(ids, many[hit])))
                if sum(len(x[0]) for x in held) > HELD_ROWS:
                    yield from dealt()

        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            if all(waiting[0].column(k)[0].equals(batch.column(k)[batch.num_rows - 1]) for k in keys):
                continue  # sorted: all of one key
            table = pa.Table.from_batches(waiting).combine_chunks()
            new = np.zeros(table.num_rows, dtype=bool)
            for k in keys:
                col = table.column(k).chunk(0)
                new[1:] |= np.asarray(pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)))
            new[0] = True
            start = np.flatnonzero(new)
            yield from whole(table.slice(0, start[-1]), start[:-1])
            waiting = table.slice(start[-1]).to_batches()
        if waiting:
            yield from whole(pa.Table.from_batches(waiting).combine_chunks(), np.zeros(1, np.int64))
        yield from dealt()

    return rows.mapInArrow(run, KNOWN_DDL)


def keys_of(known: DataFrame) -> DataFrame:
    """(a, b, id, f, word) of the frequent keys, a row each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                cols = [pa.array(unpacked(r[c], np.int64)) for c in ("a", "b", "id", "f")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(r["words"] or [None] * len(cols[0]), pa.binary())], names=["a", "b", "id", "f", "word"])
    return known.filter("chunk = -1").mapInArrow(run, "a long, b long, id long, f long, word binary")


def joined(left: DataFrame, known: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], ddl: str) -> DataFrame:
    """Each chunk's relation with the frequent keys found in it."""
    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        return f(mine, theirs.rename_columns([c.removeprefix("k_") for c in theirs.column_names]))
    known = known.select(*[F.col(c).alias(f"k_{c}") for c in known.columns])
    return left.groupBy("chunk").cogroup(known.groupBy("k_chunk")).applyInArrow(run, ddl)


def mine_phrases(docs: DataFrame, least: int = 30, longest: int = 4, text_col: str = "text", lang_col: str = "lang",
                 chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(phrases, sizes): every phrase of 1 to ``longest`` words that occurs at least ``least`` times in its language, as
    (lang, phrase, k, a), phrase with single spaces; and (lang, n), all word occurrences of a language.

    A null language is ``und``; null and empty texts have no words; repeated rows count each; other columns are ignored;
    an empty table gives empty results. Every occurrence counts, overlapping ones too.
    """
    first = written(occurrences(docs, text_col, lang_col, chunk_bytes), "phrases-1")
    words = first.select("chunk", F.inline("words"))
    known = written(frequent(words, ["word"], 1, least), "words")
    # a language may hold spaces, a word none; words come from strings, so the casts are exact
    pair = F.col("word").cast("string")
    spelt = written(keys_of(known).select("id", "f", F.regexp_replace(pair, " [^ ]*$", "").alias("lang"), F.substring_index(pair, " ", -1).alias("phrase")), "vocabulary")
    last_words = spelt.select(F.col("id").alias("last"), F.col("phrase").alias("word"))
    sizes = words.groupBy(F.regexp_replace(pair, " [^ ]*$", "").alias("lang")).agg(F.sum("n").alias("n"))
    found = [spelt.select("lang", "phrase", F.lit(1).alias("k"), F.col("f").alias("a"))]

    codes = first.select("chunk", "codes")
    back = known.filter("chunk >= 0").select("chunk", "k", "a", "b", "id")
    level = groups = None
    for k in range(2, longest + 1):
        if k == 2:
            groups = joined(codes, back, count_pairs, PAIRS_DDL)
        else:
            if k == 3:
                level = joined(codes, back, extend_pairs, LEVEL_DDL)
            else:
                level = joined(level.select("chunk", F.lit(k - 1).alias("k"), "heads", "lasts", "places"), back, extend_phrases, LEVEL_DDL)
            level = written(level, f"phrases-{k}")
            groups = level.select("chunk", F.inline("groups"))
        known = written(frequent(groups, ["head", "last"], k, least), f"groups-{k}")
        new = keys_of(known).select("id", "f", F.col("a").alias("head"), F.col("b").alias("last"))
        spelt = (new.join(spelt.select("lang", F.col("id").alias("head"), F.col("phrase").alias("start")), "head").join(last_words, "last")
                 .select("lang", "id", "f", F.concat_ws(" ", "start", "word").alias("phrase")))
        spelt = written(spelt, f"spelt-{k}")
        found.append(spelt.select("lang", "phrase", F.lit(k).alias("k"), F.col("f").alias("a")))
        mine = known.filter("chunk >= 0").select("chunk", "k", "a", "b", "id")
        back = back.union(mine) if k == 2 else mine
    out = found[0]
    for df in found[1:]:
        out = out.union(df)
    return out, sizes


def score_phrases(phrases: DataFrame, sizes: DataFrame, share: int = 80, scale: int = 2_000_000) -> DataFrame:
    """(lang, phrase, k, a, l, r, n, score) of the phrases of two words and more that no longer phrase covers.

    Cutting a phrase after its first words gives the counts l and r of the two parts; the score is the least
    floor(scale * a / (l + r)) over the cuts, the first of equals. A phrase goes if a longer one that holds its words
    occurs at least ``share`` % as often: it is enough to look one word further, for a phrase between the two occurs at
    least as often as the longer one. Products are decimals of 38 digits.
    """
    many = phrases.filter("k > 1").withColumn("words", F.split("phrase", " "))
    covered = (many.filter("k > 2")
               .select("lang", F.col("a").alias("f"), F.explode(F.array(F.expr("slice(words, 1, k - 1)"), F.expr("slice(words, 2, k - 1)"))).alias("part"))
               .select("lang", "f", F.array_join("part", " ").alias("phrase"))
               .groupBy("lang", "phrase").agg(F.max("f").alias("f")))
    kept = (many.join(covered, ["lang", "phrase"], "left")
            .filter(F.col("f").isNull() | (F.col("f").cast("decimal(38,0)") * 100 < F.col("a").cast("decimal(38,0)") * share)).drop("f"))
    cuts = kept.select("lang", "phrase", "k", "a", "words", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", F.array_join(F.expr("slice(words, 1, cut)"), " ").alias("left"),
                       F.array_join(F.expr("slice(words, cut + 1, k - cut)"), " ").alias("right"))
    part = phrases.select("lang", "phrase", "a")
    cuts = (cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
            .join(part.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"]))
    value = F.expr(f"(CAST(a AS DECIMAL(38,0)) * {scale}) div (CAST(l AS DECIMAL(38,0)) + CAST(r AS DECIMAL(38,0)))")
    best = F.min(F.struct(value.cast("long").alias("score"), "cut", "l", "r")).alias("best")
    return (cuts.groupBy("lang", "phrase", "k", "a").agg(best).join(sizes, "lang")
            .select("lang", "phrase", "k", "a", "best.l", "best.r", "n", "best.score"))


def top_phrases(scored: DataFrame, most: int = 2000) -> DataFrame:
    """Each language's first phrases by score, count and bytes, with their rank."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
