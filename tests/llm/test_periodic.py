"""Operator 11 against brute force: planted runs, random words of few kinds, long documents in tiles."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from aerocast.llm.periodic import collapse_runs, fragments, z_function
from aerocast.llm.queries import QUERIES, periodic_tail

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute_runs(w, least=6, exponent=4):
    """All maximal stretches of each period, those of a smaller period left out."""
    found = {}
    for q in range(1, len(w) // exponent + 1):
        x = 0
        while x + q < len(w):
            if w[x] != w[x + q]:
                x += 1
                continue
            lo = x
            while x + q < len(w) and w[x] == w[x + q]:
                x += 1
            if x + q - lo >= max(least, exponent * q):
                found.setdefault((lo, x + q - lo), q)  # periods ascend, the smallest stays
    return sorted((start, length, q) for (start, length), q in found.items())


def brute(text, rearrange=None, i=None):
    w = WORD.findall(text or "")
    order = rearrange(i, len(w)) if rearrange else None
    if order is not None:
        w = [w[k] for k in order]
    runs = sorted(brute_runs(w), key=lambda r: (r[0], r[2]))
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    return len(w), runs, " ".join(x for k, x in enumerate(w) if k not in gone)


def texts(rng):
    out = [None, "", " \t\n", "a", "a " * 5, "a " * 6, "a " * 1000, "a b " * 3 + "a b", "a b " * 4, "x " + "a b c " * 5 + "a", "a a a a a a b " * 40]
    out += [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 400))) for _ in range(40)]
    for _ in range(60):
        words = [f"w{rng.randrange(30)}" for _ in range(rng.randint(0, 200))]
        p = [f"w{rng.randrange(30)}" for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 40, 64]))]
        k = rng.randrange(len(words) + 1)
        times = rng.choice([3, 4, 5, 9]) * len(p) + rng.randrange(len(p) + 1) - 1
        words[k:k] = [p[x % len(p)] for x in range(max(0, times))]
        out.append(rng.choice([" ", "  ", "\n"]).join(words))
    inner = "a b c a b c a b c a b c a b c x "
    out.append(inner * 7)  # runs within the period of a run
    return out


def rows_of(df):
    return sorted(((r.doc_id is not None, r.doc_id or 0, r.n_words, [(x.start, x.length, x.period) for x in r.runs], r.text) for r in df.collect()), key=str)


def test_z_function():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randrange(2) for _ in range(rng.randrange(30))]
        z = z_function(s)
        assert all(z[i] == next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s)))


def test_fragments_are_maximal_and_complete():
    rng = random.Random(2)
    for t in texts(rng):
        w = WORD.findall(t or "")
        seq = np.unique(np.array(w, dtype=str), return_inverse=True)[1].astype(np.int32) if w else np.zeros(0, np.int32)
        q, lo, hi = fragments(seq, 1, len(seq) // 4, 6, 4)
        best = {}
        for a, b, c in zip(q.tolist(), lo.tolist(), hi.tolist(), strict=True):
            best[b, c + a - b] = min(a, best.get((b, c + a - b), a))
        assert sorted((s, n, p) for (s, n), p in best.items()) == brute_runs(w)


@pytest.mark.parametrize("long_bytes,tile_words", [(1 << 20, 1 << 15), (40, 64), (0, 32), (200, 300)])
def test_documents(spark, long_bytes, tile_words):
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(texts(rng))] + [(3, "a b " * 30), (3, "a b " * 30), (None, "b " * 9), (None, None)]
    df = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], "doc_id long, text string, key string, period int, lo int").repartition(5)
    got = rows_of(collapse_runs(df, long_bytes=long_bytes, tile_words=tile_words))
    want = sorted(((i is not None, i or 0, *brute(t)) for i, t in rows), key=str)
    assert got == want


def test_query(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([1, 3, 20, 90, 300])))) for i in range(300)] + [(900, None), (901, "a " * 50)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()}
    assert len(out) == len(rows)
    seen = collections.Counter()
    for i, t in rows:
        n, runs, text = brute(t, periodic_tail, i)
        r = out[i]
        assert r.n_runs == len(runs)
        seen[len(runs) > 0] += 1
        if runs:
            from fractions import Fraction
            s, length, q = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, length, q, 1000 * length // q)
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert seen[True] > 10


def test_long_run_over_many_tiles(spark):
    w = [f"w{k % 700}" for k in range(9000)]
    w[4500:4500] = ["x"]
    df = spark.createDataFrame([(1, " ".join(w)), (2, "a " * 5000)], "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in collapse_runs(df, long_bytes=1000, tile_words=256).collect()}
    assert got == {1: [(0, 4500, 700), (4501, 4500, 700)], 2: [(0, 5000, 1)]}


def test_empty_table(spark):
    assert collapse_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
