"""Near-duplicate detection with bottom-k sketches of one hash function (operator 7).

A document's set holds its distinct word shingles; its sketch, the k smallest hashes
of the set. Steps, all of them joins and groupings:

1. Equal sets become one class, known by its smallest doc_id; the rest works on classes.
2. Retained values are ordered by how many sketches hold them, and each class enters
   the inverted lists of its rarest values only: two sketches that share what similar sets
   share must meet in ``MEET`` of these lists, so a value that very many documents hold is
   not listed where it can't decide. Each class is compared with the smallest class of a list.
3. Classes that still meet enough classes of other components are listed again, by the rarest
   values of their full sets. A sketch of 64 leaves a wide margin; the full sets have none: a
   text with more values of its own than a link allows is in no list with others. Each
   class is compared with the one of a list that has the fewest values of its own, then
   with the classes of other components as far as what both hold from a common value on
   can make a link. So a group of n texts made from one text costs about n pairs and those
   of the few texts just beside the limit.
4. Pairs are gathered by blocks of classes that met in step 2, whose texts go once to each pair of parts of a block,
   not once a pair. There the union-sketch estimate drops pairs that are clearly below the limit.
5. Full sets, made again from the whole texts, confirm each link; links give components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerocast.llm.common import FEW_BYTES, LOWER, clean_documents, large_binaries, mix, scratch, signed, slices, span_hashes, spare, text_hashes, window_hashes, windows_in_rows, word_spans, written
from aerocast.llm.components import components

#: Values of a sketch. With J >= 0.8 the union sketch of 64 shares 51 +- 3 values; fewer than SHARE of 64 is six
#: standard deviations away (below 1e-8 for a pair just at 0.8); sets so small that both are held whole are exact.
SKETCH, SHARE = 64, 0.5
#: Lists in which two classes must meet.
MEET = 4
#: Shingles of a part of a block, on average; two parts at a time are compared by one task.
CELL = 1 << 16
#: Bits of a bitmap for each wanted id, and in all (16 MB).
BITS, MOST_BITS = 32, 1 << 27


def shingle_sets(texts: pa.LargeBinaryArray, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, row, hash): the distinct shingles, ordered by row and hash."""
    for first, last, data, offsets in slices(texts, FEW_BYTES):
        low = LOWER[data]
        starts, ends, head = word_spans(low, offsets)
        words = text_hashes(low, starts, ends)
        at = windows_in_rows(head, shingle)
        count = np.diff(head)
        short = np.flatnonzero((count > 0) & (count < shingle))
        rows = np.repeat(np.arange(last - first), count)
        row = np.concatenate((rows[at], short))
        h = np.concatenate((window_hashes(words, shingle)[at] if len(at) else np.zeros(0, np.uint64),
                            mix(span_hashes(words, head[short], head[short + 1]) + np.uint64(1)) if len(short) else np.zeros(0, np.uint64)))
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        if len(h):
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            row, h = row[new], h[new]
        yield first, last, row, h


def _features(docs: DataFrame, shingle: int, size: int) -> DataFrame:
    """(doc_id, text_key, n, key1, key2, sketch); the keys are two sums over the set, so equal sets have equal keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, row, h in shingle_sets(large_binaries(batch.column(2)), shingle):
                m = last - first
                head = np.searchsorted(row, np.arange(m + 1))
                sums = [np.concatenate(([np.uint64(0)], np.cumsum(mix(h ^ np.uint64(c)), dtype=np.uint64))) for c in (0x2545F491, 0x9E3779B9)]
                keys = [signed(s[head[1:]] - s[head[:-1]]) for s in sums]
                kept = np.arange(len(h)) - head[row] < size
                sizes = np.minimum(np.diff(head), size)
                sketch = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(signed(h[kept])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, m), batch.column(1).slice(first, m), pa.array(np.diff(head).astype(np.int64)),
                                                  pa.array(keys[0]), pa.array(keys[1]), sketch],
                                                 names=["doc_id", "text_key", "n", "key1", "key2", "sketch"])
    return docs.select("doc_id", "text_key", "text").mapInArrow(spare(run), "doc_id long, text_key long, n long, key1 long, key2 long, sketch array<long>")


def _prefixes(sketches: DataFrame, similarity: float, size: int, share: float) -> DataFrame:
    """(id, n, meet, listed): the values under which each class is listed, its rarest ones."""
    s = F.size("sketch")
    whole = math.floor(size * similarity)  # up to this set size the partner's set is held whole too
    least = F.when(F.col("n") <= whole, F.ceil(F.lit(round(similarity, 6)) * s - 1e-9)).otherwise(F.ceil(F.lit(share) * s)).cast("int")
    sketches = sketches.withColumn("least", F.greatest(least, F.lit(1)))
    sketches = sketches.withColumn("meet", F.least(F.col("least"), F.when(s < 16, 1).otherwise(MEET)))
    values = sketches.select("id", F.explode("sketch").alias("v"))
    common = values.groupBy("v").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    # dealt by id as plain rows, which take half the room that collected ones take in a shuffle
    shared = (values.join(common, "v").repartition("id").groupBy("id")
              .agg(F.sort_array(F.collect_list(F.struct("held", "v"))).alias("shared")))
    slim = sketches.select("id", "n", "least", "meet", s.alias("s"))
    # values that no other sketch holds are the rarest; they take their places, but need no list
    places = F.col("s") - F.col("least") + F.col("meet") - (F.col("s") - F.size("shared"))
    return (slim.join(shared, "id").withColumn("listed", F.slice("shared.v", F.lit(1), F.greatest(places, F.lit(0))))
            .filter(F.size("listed") > 0).select("id", "n", "meet", "listed"))


def _similar_size(a: str, b: str, similarity: float):
    return (F.least(a, b) * 100 >= F.greatest(a, b) * round(similarity * 100))


def _star_pairs(lists: DataFrame, similarity: float) -> DataFrame:
    """(a, b): each class with the smallest class of a list, where they meet often enough."""
    at = lists.select(F.explode("listed").alias("v"), "id", "n", "meet")
    heads = at.groupBy("v").agg(F.min(F.struct("id", "n", "meet")).alias("head"), F.count(F.lit(1)).alias("held")).filter("held > 1")
    return (at.join(heads.select("v", "head"), "v").filter("id <> head.id")
            .filter(_similar_size("n", "head.n", similarity))
            .groupBy(F.col("head.id").alias("a"), F.col("id").alias("b"))
            .agg(F.count(F.lit(1)).alias("met"), F.first(F.least("meet", "head.meet")).alias("due")).filter("met >= due").select("a", "b"))


def _labelled(at: DataFrame, labels: DataFrame) -> DataFrame:
    return at.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))


def _band(similarity: float):
    """Bands of sizes: linked sets lie in the same one or in neighbours."""
    return F.floor(F.log(F.col("n")) / max(-math.log(round(similarity * 100) / 100), 1e-3) + 1e-9)


def _open(lists: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """(id): the classes that may have a link to another component. Components are dealt into 64 numbers; a class goes on
    if it shares enough lists with other components of one number, of sizes near its own. No pairs are made."""
    number = F.pmod(F.xxhash64("label"), F.lit(64)).cast("int").alias("number")
    due = F.when(F.col("n") * similarity < 16, 1).otherwise(F.col("meet")).alias("due")
    at = _labelled(lists, labels).select(F.explode("listed").alias("v"), "id", "label", number, _band(similarity).alias("band"), due)
    held = at.groupBy("v", "band", "number").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    held = (held.groupBy("v").agg(F.collect_list(F.struct("band", "number", "lo", "hi")).alias("held"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            .filter("lo < hi").select("v", "held"))
    # the numbers in which a list has another component than the class's own, by at most 64 numbers of each band
    others = F.expr("aggregate(held, 0L, (m, h) -> if(abs(h.band - band) <= 1 and (h.lo <> label or h.hi <> label), m | shiftleft(1L, h.number), m))")
    masks = (at.join(held, "v").select("id", "due", others.alias("mask")).filter("mask <> 0")
             .groupBy("id").agg(F.collect_list("mask").alias("masks"), F.first("due").alias("due")).filter(F.size("masks") >= F.col("due")))
    # element k: the numbers met in more than k lists
    none = F.array(*[F.lit(0).cast("long")] * MEET)
    met = F.aggregate("masks", none, lambda c, m: F.array(c[0].bitwiseOR(m), *[c[k].bitwiseOR(c[k - 1].bitwiseAND(m)) for k in range(1, MEET)]))
    return masks.filter(F.element_at(met, F.col("due")) != 0).select("id")


def _likely(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of texts whose doc_id is wanted, and of the others about one in ``BITS``: by a bitmap of hashed ids that
    all tasks get, of at most ``MOST_BITS`` bits whatever the tables' size, so that texts which no one asks for are not
    shuffled to be joined."""
    bits = min(max(wanted.count() * BITS, 1 << 15), MOST_BITS)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    pages = (wanted.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("page"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap")))
    placed = texts.withColumn("place", place).withColumn("page", F.bitmap_bucket_number("place")).withColumn("at", F.bitmap_bit_position("place"))
    byte = F.conv(F.hex(F.expr("substring(bitmap, cast(at div 8 as int) + 1, 1)")), 16, 10).cast("long")
    found = placed.join(F.broadcast(pages), "page").filter(F.getbit(byte, F.pmod("at", F.lit(8)).cast("int")) == 1)
    return found.select(*texts.columns)


def _picked(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text): one text of each wanted (id, text_key)."""
    wanted = wanted.select(F.col("id").alias("doc_id"), F.col("text_key").alias("key"))
    # joined by doc_id alone, as the rows are then made distinct by it: one shuffle
    picked = _likely(texts, wanted).join(wanted, "doc_id").filter(F.col("text_key").between(F.col("key"), F.col("key")))
    return picked.dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("id"), "text")


def _full_lists(picked: DataFrame, shingle: int, similarity: float, folder: str) -> DataFrame:
    """(v, id, n, rest): the full sets' rarest values, of each as many as hold the first common value with any linked set.
    ``rest`` counts the set's values from v on, in the one order of all sets (rarest first): two sets whose first common
    value is v share no more than the smaller ``rest``."""
    percent = round(similarity * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, row, h in shingle_sets(large_binaries(batch.column(1)), shingle):
                head = np.searchsorted(row, np.arange(last - first + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.ListArray.from_arrays(pa.array(head, pa.int32()), pa.array(signed(h)))],
                                                 names=["id", "vs"])

    sets = written(picked.select("id", "text").mapInArrow(spare(run), "id long, vs array<long>"), "sets", folder)
    values = sets.select("id", F.explode("vs").alias("v"))
    common = values.groupBy("v").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    shared = values.join(common, "v").repartition("id").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("held", "v"))).alias("shared"))
    shared = shared.join(sets.select("id", F.size("vs").alias("n")), "id")
    single = F.col("n") - F.size("shared")  # values that no other set holds come first and need no list
    places = F.col("n") - F.floor((F.col("n") * percent + 99) / 100).cast("int") + 1 - single
    listed = shared.select("id", "n", single.alias("single"), F.slice("shared.v", F.lit(1), F.greatest(places, F.lit(0))).alias("listed"))
    at = listed.select("id", "n", "single", F.posexplode("listed").alias("k", "v"))
    return written(at.select("v", "id", "n", (F.col("n") - F.col("single") - F.col("k")).alias("rest")), "at", folder)


def _enough(resta, restb, na, nb, similarity: float):
    """True if sets of these sizes can be linked when they share no more than the smaller rest."""
    percent = round(similarity * 100)
    return F.least(F.col(resta), F.col(restb)) * (100 + percent) >= (F.col(na) + F.col(nb)) * percent


def _near_heads(at: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """(a, b): each class with the class of a list and a band of sizes that has the fewest values of its own, so that of
    texts made from one text nearly all meet what is closest to it. Heads of its own band and of the one below."""
    at = _labelled(at, labels).withColumn("band", _band(similarity))
    best = F.max(F.struct((F.col("rest") / F.col("n")).alias("part"), (-F.col("id")).alias("back"), "id", "n", "rest", "label")).alias("head")
    heads = at.groupBy("v", "band").agg(best)
    heads = heads.union(heads.select("v", F.col("band") + 1, "head"))
    return (at.join(heads.toDF("v", "band", "head"), ["v", "band"]).filter("label <> head.label")
            .filter(_enough("rest", "head.rest", "n", "head.n", similarity))
            .select(F.col("head.id").alias("a"), F.col("id").alias("b")).distinct())


def _cross_pairs(at: DataFrame, labels: DataFrame, similarity: float, folder: str) -> DataFrame:
    """(a, b): all classes of different components that can still be linked by what they share from a common value on.
    A list is first paired by component and band of sizes, so that classes that are already connected make no pairs, and
    a set that has too many values of its own is dropped against a whole component at once. Of two components the one with
    fewer classes in the list is spelt out first."""
    band = F.floor(F.log(F.col("n")) / math.log(1.02)).alias("band")
    at = _labelled(at, labels)
    mixed = at.groupBy("v").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("v")
    at = written(at.join(mixed, "v").select("v", "label", band, "id", "n", "rest"), "mixed", folder)
    sides = at.groupBy("v", "label", "band").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n"), F.max("rest").alias("rest"))

    def side(of: DataFrame, x: str) -> DataFrame:
        return of.select(*[F.col(c).alias(f"{c}{x}") for c in of.columns])

    order = (F.col("ka") < F.col("kb")) | ((F.col("ka") == F.col("kb")) & (F.col("labela") < F.col("labelb")))
    two = side(sides, "a").join(side(sides, "b"), (F.col("va") == F.col("vb")) & (F.col("labela") != F.col("labelb")) & order & _enough("resta", "restb", "na", "nb", similarity))
    few = two.select(F.col("va").alias("v"), F.col("labela").alias("label"), F.col("banda").alias("band"), "labelb", "bandb", "nb", "restb")
    left = few.join(at, ["v", "label", "band"]).filter(_enough("rest", "restb", "n", "nb", similarity)).select("v", F.col("labelb").alias("label"), F.col("bandb").alias("band"), F.col("id").alias("ida"), F.col("n").alias("na"), F.col("rest").alias("resta"))
    right = at.select("v", "label", "band", F.col("id").alias("idb"), F.col("n").alias("nb"), F.col("rest").alias("restb"))
    right = right.toDF("vb", "labelb", "bandb", "idb", "nb", "restb")
    many = left.join(right, (F.col("v") == F.col("vb")) & (F.col("label") == F.col("labelb")) & (F.col("band") == F.col("bandb"))
                     & _enough("resta", "restb", "na", "nb", similarity))
    return many.select(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b")).distinct()


def _star_cells(pairs: DataFrame) -> DataFrame:
    """(u, m, x): each head with what it meets."""
    return pairs.select(F.col("a").alias("u"), F.col("a").alias("m"), F.col("b").alias("x"))


def _block_cells(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(u, m, x): pairs by the larger one of their two blocks, u; m is the class in it. Texts that are nearly alike lie
    in one block, so they meet there many at a time."""
    sizes = blocks.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    blocks = blocks.join(sizes, "label")

    def of(x: str) -> DataFrame:
        return blocks.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"), F.col("size").alias(f"s{x}"))

    pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    label = {x: F.coalesce(f"l{x}", x) for x in "ab"}
    size = {x: F.coalesce(f"s{x}", F.lit(1)) for x in "ab"}
    first = (size["a"] > size["b"]) | ((size["a"] == size["b"]) & (label["a"] <= label["b"]))
    return pairs.select(F.when(first, label["a"]).otherwise(label["b"]).alias("u"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("m"),
                        F.when(first, F.col("b")).otherwise(F.col("a")).alias("x"))


def union_share(x: np.ndarray, y: np.ndarray, size: int) -> float:
    """Share of the union's ``size`` smallest values that both ascending sets hold; from their own smallest ones."""
    both = np.sort(np.concatenate((x[:size], y[:size])))
    again = both[1:] == both[:-1]
    union = both[np.concatenate(([True], ~again))][:size]
    return np.count_nonzero(again & (both[1:] <= union[-1])) / len(union)


def _confirmed(cells: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, similarity: float, size: int, limit: float, folder: str) -> DataFrame:
    """The pairs of (u, m, x) whose full sets reach the similarity, as (a, b). Both sides of each u are cut by hash into
    parts of about CELL shingles; a part of one meets a part of the other in one task, to which a text goes once however
    many pairs it is in. There the union-sketch estimate comes first, from the sets' smallest values."""
    cells = written(cells, "candidates", folder)
    ends = cells.select("u", F.lit(0).alias("side"), F.col("m").alias("id")).union(cells.select("u", F.lit(1), "x")).distinct()
    ends = written(ends.join(classes.select("id", "n", "text_key"), "id"), "ends", folder)
    parts = ends.groupBy("u").agg(*[F.ceil(F.sum(F.when(F.col("side") == k, F.col("n")).otherwise(0)) / CELL).alias(c) for k, c in ((0, "ps"), (1, "qs"))])
    picked = _picked(texts, written(ends.select("id", "text_key").distinct(), "wanted", folder))
    cells = cells.join(parts, "u").select("u", F.pmod(F.xxhash64("m"), "ps").alias("p"), F.pmod(F.xxhash64("x"), "qs").alias("q"), "m", "x")
    cells = written(cells, "cells", folder)
    sent = cells.select("u", "p", "q", F.col("m").alias("id")).union(cells.select("u", "p", "q", "x")).distinct()
    sent = sent.join(picked, "id").select(F.col("u").alias("su"), F.col("p").alias("sp"), F.col("q").alias("sq"), "id", "text")
    percent = round(similarity * 100)
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def confirm(pairs: pa.Table, held: pa.Table) -> pa.Table:
        sets: list[np.ndarray] = []
        for first, last, row, h in shingle_sets(large_binaries(held.column("text")), shingle):
            sets += np.split(h, np.searchsorted(row, np.arange(1, last - first)))
        at = {i: k for k, i in enumerate(held.column("id").to_pylist())}
        ids = np.array([[at[i] for i in pairs.column(c).to_pylist()] for c in ("m", "x")]).reshape(2, -1)
        good = np.zeros(ids.shape[1], dtype=bool)
        for k, (i, j) in enumerate(ids.T):
            x, y = sets[i], sets[j]
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and union_share(x, y, size) >= limit:
                near = np.minimum(np.searchsorted(x, y), len(x) - 1)
                common = int(np.count_nonzero(x[near] == y))
                good[k] = 100 * common >= percent * (len(x) + len(y) - common)
        m, x = (np.asarray(pairs.column(c))[good] for c in ("m", "x"))
        return pa.table([pa.array(np.minimum(m, x), pa.int64()), pa.array(np.maximum(m, x), pa.int64())], schema=out)

    links = cells.groupBy("u", "p", "q").cogroup(sent.groupBy("su", "sp", "sq")).applyInArrow(confirm, "a long, b long")
    return written(links, "links", folder)


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, size: int = SKETCH, share: float = SHARE) -> DataFrame:
    """Groups of near duplicates.

    Words are runs of non-space bytes with A-Z lower-cased; a document's set holds its
    distinct runs of ``shingle`` words (with fewer words, the whole sequence; without words,
    nothing). Documents are linked if 100 * common >= 100 * similarity * union.

    Result, one row per distinct doc_id of the input: ``doc_id``, ``n_shingles`` long,
    ``component_id`` (smallest doc_id reachable by links, itself included) and ``kept``
    (doc_id = component_id). Null and empty texts have n_shingles 0 and are linked with
    nothing; rows with a null doc_id are left out; of rows that repeat a doc_id the one with
    the largest set counts. Only doc_id and text are read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    limit = similarity * share / 0.8  # of the estimate, far below what a link can have
    texts = clean_documents(docs).filter("doc_id IS NOT NULL").withColumn("text_key", F.xxhash64("text"))
    with scratch(spark) as tmp:
        with scratch(spark) as once:
            with scratch(spark) as early:
                features = written(_features(texts, shingle, size), "sketches", early)
                one = features.groupBy("doc_id").agg(F.max(F.struct("n", "key1", "key2", "text_key")).alias("f")).select("doc_id", "f.*")
                one = written(one, "documents")
                classes = (one.filter("n > 0").groupBy("key1", "key2", "n")
                           .agg(F.min(F.struct(F.col("doc_id").alias("id"), "text_key")).alias("first")).select("key1", "key2", "n", "first.*"))
                classes = written(classes, "classes", tmp)
                # equal sets have equal sketches
                sketches = features.filter("n > 0").groupBy("key1", "key2", "n").agg(F.first("sketch").alias("sketch"))
                sketches = written(sketches.join(classes, ["key1", "key2", "n"]).select("id", "n", "sketch"), "sketches", once)
            lists = written(_prefixes(sketches, similarity, size, share), "lists", tmp)

        star = written(_star_pairs(lists, similarity), "pairs", tmp)
        links = _confirmed(_star_cells(star), classes, texts, shingle, similarity, size, limit, tmp)
        blocks = components(star, tmp)
        with scratch(spark) as joined:
            labels = components(links, tmp)
            wanted = written(_open(lists, labels, similarity).join(classes.select("id", "text_key"), "id"), "open", joined)
            at = _full_lists(_picked(texts, wanted), shingle, similarity, joined)
            near = written(_near_heads(at, labels, similarity), "pairs", tmp)
            links = links.union(_confirmed(_star_cells(near), classes, texts, shingle, similarity, size, limit, tmp))
            cross = written(_cross_pairs(at, components(links, tmp), similarity, joined), "pairs", tmp)
        rest = _confirmed(_block_cells(cross, blocks), classes, texts, shingle, similarity, size, limit, tmp)
        labels = components(links.union(rest), tmp)
        of_class = (classes.select("id", "n", "key1", "key2").join(labels.withColumnRenamed("node", "id"), "id", "left")
                    .select("n", "key1", "key2", F.coalesce("label", "id").alias("label")))
        of_class = written(of_class, "labels")
    component = F.coalesce("label", "doc_id")
    return (one.join(of_class, ["n", "key1", "key2"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept")))
