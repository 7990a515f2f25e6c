"""Operator 13 against brute force on small tables."""

import collections
import random
import re

import pytest

from aerocast.llm.collocations import mine_phrases, score_phrases, top_phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest=4, most=2000):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    dropped = {(lang, w[i:j]) for (lang, w), b in found.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1)
               if j - i < len(w) and 100 * b >= 80 * f[lang, w[i:j]]}
    out = collections.defaultdict(list)
    for (lang, w), a in found.items():
        if (lang, w) not in dropped:
            score, _, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(x)[:most], 1))


def mined(spark, rows, least, chunk_bytes=1 << 20, most=2000, parts=3):
    df = spark.createDataFrame([(t, x, "clash", 1, 2) for t, x in rows], "text string, lang string, chunk string, n int, id int").repartition(parts)
    top = top_phrases(score_phrases(*mine_phrases(df, least, chunk_bytes=chunk_bytes)), most)
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in top.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = []
    for i in range(120):
        alphabet = ["the", "The", "of", "é", "漢字", "a", "b", "Ä", "|", "x-y"]
        out.append(("".join(rng.choice(alphabet) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "  "]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "fr", None, "und"])))
    out += [("of the of the of the " * 40, "en"), ("a " * 300, "en"), (None, "en"), ("", None), (" .,; ", "xx"), ("New York City! " * 20, "en")]
    return out + out[:20]


@pytest.mark.parametrize("least,chunk_bytes", [(2, 1 << 20), (5, 100), (30, 1)])
def test_phrases_equal_brute_force(spark, rows, least, chunk_bytes):
    assert mined(spark, rows, least, chunk_bytes) == brute(rows, least)


def test_ranks_and_limits(spark, rows):
    assert mined(spark, rows, 2, most=3) == brute(rows, 2, most=3)


def test_no_rows_and_no_phrases(spark):
    assert mined(spark, [], 2, parts=1) == []
    assert mined(spark, [(None, None), ("", "en"), ("one two three", "en")], 2) == []
    assert mined(spark, [("one two", "en"), ("one, two", "en"), ("one\ntwo", "en")], 2) == []


def test_columns_of_sizes(spark):
    df = spark.createDataFrame([("a b. c", None), ("d", "und"), (None, "fr")], "text string, lang string")
    _, sizes = mine_phrases(df, 2)
    assert sorted(map(tuple, sizes.collect())) == [("und", 4)]
