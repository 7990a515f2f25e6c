"""The union-sketch estimate against sets of Python."""

from __future__ import annotations

import itertools
import random

import numpy as np

from aerocast.llm.minhash import union_share


def test_union_share_is_the_share_of_the_smallest_union_values():
    rng = np.random.default_rng(7)
    for size in (1, 4, 64):
        for _ in range(200):
            x, y = (np.unique(rng.integers(0, 120, rng.integers(1, 90)).astype(np.uint64)) for _ in "xy")
            union = sorted(set(x.tolist()) | set(y.tolist()))[:size]
            due = len(set(union) & set(x.tolist()) & set(y.tolist())) / len(union)
            assert union_share(x, y, size) == due


def test_union_share_of_equal_and_of_disjoint_sets():
    x = np.arange(10, dtype=np.uint64)
    assert union_share(x, x, 64) == 1
    assert union_share(x, x + np.uint64(10), 64) == 0


def test_a_group_made_from_one_text_costs_few_pairs(spark, monkeypatch):
    """Texts on both sides of the limit: each is compared with few others, not with the whole group."""
    import aerocast.llm.minhash as M
    rng = random.Random(11)
    base = [f"w{i}" for i in range(160)]
    docs = []
    for i in range(400):
        rate = rng.uniform(0, 0.16)
        docs.append((i, " ".join(f"x{rng.random()}" if rng.random() < rate else w for w in base)))
    pairs = []

    def counted(df, name, folder=None, write=M.written):
        out = write(df, name, folder)
        if name == "pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(M, "written", counted)
    out = {r.doc_id: r.component_id for r in M.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=2).collect()}
    sets = [set(zip(w, w[1:], strict=False)) for _, t in docs for w in [t.split()]]
    want = list(range(len(docs)))
    for a, b in itertools.combinations(range(len(docs)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and want[a] != want[b]:
            lo, hi = sorted((want[a], want[b]))
            want = [lo if x == hi else x for x in want]
    assert out == dict(enumerate(want))
    assert len(set(want)) > 100 and max(map(want.count, set(want))) > 100
    assert sum(pairs) < 8 * len(docs)


def test_texts_are_picked_without_a_shuffle_of_the_others(spark):
    from pyspark.sql import functions as F

    from aerocast.llm.minhash import _likely, _picked
    texts = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 7).alias("text"))
    texts = texts.union(texts.filter("doc_id < 40").withColumn("text", F.lit("another"))).withColumn("text_key", F.xxhash64("text"))
    wanted = texts.filter("doc_id % 500 = 0 and text <> 'another'").select(F.col("doc_id").alias("id"), "text_key")
    likely = [r.doc_id for r in _likely(texts, wanted.withColumnRenamed("id", "doc_id")).collect()]
    assert set(range(0, 20000, 500)) <= set(likely) and len(likely) < 2000
    assert sorted(map(tuple, _picked(texts, wanted).collect())) == [(i, f"text {i % 7}") for i in range(0, 20000, 500)]
    assert _picked(texts, wanted.limit(0)).count() == 0


def test_open_classes_are_those_that_meet_another_component(spark):
    from aerocast.llm.minhash import _band, _open
    rng = random.Random(5)
    rows = [(i, rng.choice((40, 45, 60, 200)), rng.randint(1, 4), sorted(rng.sample(range(120), rng.randint(1, 9)))) for i in range(150)]
    lists = spark.createDataFrame(rows, "id long, n long, meet int, listed array<long>")
    label = {i: i - i % 5 for i in range(90)}
    labels = spark.createDataFrame(list(label.items()), "node long, label long")
    of = {i: label.get(i, i) for i in range(150)}
    band = {r.id: r.band for r in lists.select("id", _band(0.8).alias("band")).collect()}
    number = {r.id: r.number for r in lists.selectExpr("id", "cast(pmod(xxhash64(id), 64) as int) as number").collect()}
    want = set()
    for i, n, meet, mine in rows:
        met = {}
        for v in mine:
            for k in {number[of[j]] for j, _, _, other in rows if v in other and of[j] != of[i] and abs(band[i] - band[j]) <= 1}:
                met[k] = met.get(k, 0) + 1
        if any(c >= (1 if n * 0.8 < 16 else meet) for c in met.values()):
            want.add(i)
    assert {r.id for r in _open(lists, labels, 0.8).collect()} == want and 0 < len(want) < 150
