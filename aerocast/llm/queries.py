"""The registered queries opN_<name> of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f
    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


@query("op2_byte_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from aerocast.llm.bpe import encode_documents
    return encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                            public_tokenizers.PATTERN, with_ids=False)


@query("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from aerocast.llm.token_counts import count_tokens
    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aerocast.llm.quality import score_quality
    scored = score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.round("quality_score", 6).alias("score"), F.col("quality_keep").alias("kept"))


OP10_SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, unnest(range(len(lines) - 2)) AS pos, lines FROM l WHERE len(lines) >= 3),
k AS (SELECT doc_id, pos, lines[pos + 1] || chr(10) || lines[pos + 2] || chr(10) || lines[pos + 3] AS win FROM w),
n AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS occurrence FROM k),
g AS (SELECT DISTINCT doc_id, pos + o AS pos FROM n, (SELECT unnest([0, 1, 2]) AS o) WHERE occurrence > 1),
e AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM l),
r AS (SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.pos) AS kept
      FROM e ANTI JOIN g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)
SELECT l.doc_id, len(l.lines)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256
FROM l LEFT JOIN c USING (doc_id) LEFT JOIN r USING (doc_id)"""


@query("op10_line_dedup", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aerocast.llm.line_dedup import dedup_lines
    kept = dedup_lines(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


@query("op1_url_filter")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aerocast.llm.url_filter import filter_urls
    return filter_urls(read(spark, sf_dir, "pages"), URL_RULES)


@query("op3_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aerocast.llm.decontaminate import find_leaks
    leaks = find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", *[F.round(c, 6).alias(c) for c in ("score", "question_overlap", "answer_overlap")])


OP7_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) > 1 THEN [ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))] ELSE ws END) AS sh FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, b AS reach FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a),
m AS (SELECT doc_id, min(reach) AS reach FROM r GROUP BY doc_id)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(t.doc_id, coalesce(reach, t.doc_id)) AS component_id,
  t.doc_id <= coalesce(reach, t.doc_id) AS kept FROM t LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""


@query("op7_minhash_dedup", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aerocast.llm.minhash import near_duplicates
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=2, similarity=0.8)


OP6_SQL = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS vec FROM embeddings
           WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.vec, c.vec)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


@query("op6_topk", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aerocast.llm.topk import integer_vectors, top_k
    vectors = integer_vectors(read(spark, sf_dir, "embeddings"), repeats=True)
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


OP8_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM t WHERE len(ws) >= 50),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM w),
f AS (SELECT h, min(doc_id) AS m FROM k GROUP BY h),
g AS (SELECT DISTINCT doc_id, i + o AS i FROM k JOIN f USING (h), (SELECT unnest(range(50)) AS o) WHERE m < doc_id),
e AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM t),
r AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM e ANTI JOIN g USING (doc_id, i) GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN c USING (doc_id) LEFT JOIN r USING (doc_id)"""


@query("op8_substring_dedup", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aerocast.llm.substring import remove_repeats
    return remove_repeats(read(spark, sf_dir, "documents"), with_text=False)


OP9_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM t),
q AS (SELECT doc_id, i, w, lag(w, 1) OVER d AS v, lag(w, 2) OVER d AS u FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT count(*) AS n FROM p),
d1 AS (SELECT doc_id, w, count(*) AS c FROM q GROUP BY ALL), t1 AS (SELECT w, sum(c) AS c FROM d1 GROUP BY ALL),
d2 AS (SELECT doc_id, v, w, count(*) AS c FROM q WHERE i > 0 GROUP BY ALL), t2 AS (SELECT v, w, sum(c) AS c FROM d2 GROUP BY ALL),
d3 AS (SELECT doc_id, u, v, w, count(*) AS c FROM q WHERE i > 1 GROUP BY ALL), t3 AS (SELECT u, v, w, sum(c) AS c FROM d3 GROUP BY ALL),
c1 AS (SELECT doc_id, w, t1.c - d1.c AS c FROM d1 JOIN t1 USING (w)),
c2 AS (SELECT doc_id, v, w, t2.c - d2.c AS c FROM d2 JOIN t2 USING (v, w)),
c3 AS (SELECT doc_id, u, v, w, t3.c - d3.c AS c FROM d3 JOIN t3 USING (u, v, w)),
s AS (SELECT q.doc_id, q.i, CASE
        WHEN c3.c > 0 THEN ln(c3.c::DOUBLE / uv.c)
        WHEN c2.c > 0 THEN ln(c2.c::DOUBLE / cv.c) + CASE WHEN q.i > 1 THEN ln(0.4) ELSE 0 END
        ELSE ln(greatest(c1.c, 1)::DOUBLE / n.n) + least(q.i, 2) * ln(0.4) END AS l
      FROM q CROSS JOIN n JOIN c1 ON c1.doc_id = q.doc_id AND c1.w = q.w
      LEFT JOIN c1 cv ON cv.doc_id = q.doc_id AND cv.w = q.v
      LEFT JOIN c2 ON c2.doc_id = q.doc_id AND c2.v = q.v AND c2.w = q.w
      LEFT JOIN c2 uv ON uv.doc_id = q.doc_id AND uv.v = q.u AND uv.w = q.v
      LEFT JOIN c3 ON c3.doc_id = q.doc_id AND c3.u = q.u AND c3.v = q.v AND c3.w = q.w),
g AS (SELECT doc_id, count(*) AS n_words, sum(l) AS log_score FROM s GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, round(coalesce(log_score, 0), 4) AS log_score, round(log_score / n_words, 6) AS per_word
FROM t LEFT JOIN g USING (doc_id)"""


@query("op9_stupid_backoff", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aerocast.llm.ngram_lm import score_documents
    scored = score_documents(read(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("per_word", 6).alias("per_word"))


@query("op12_token_records")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    from aerocast.llm.common import shared_folder
    from aerocast.llm.token_records import read_records, write_records
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}/token_records"
    write_records(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    back = read_records(spark, path, ids="binary")
    return back.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
             unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
           FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
o AS (SELECT lang, k, unnest([array_to_string(ws[i:i + k - 1], ' ') for i in range(1, len(ws) - k + 2)]) AS phrase
      FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM o GROUP BY ALL),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 30),
q AS (SELECT * FROM (VALUES (3, 1, 2), (3, 2, 2), (4, 1, 2), (4, 2, 2), (4, 3, 2), (4, 1, 3), (4, 2, 3)) AS q (k, x, y)),
s AS (SELECT DISTINCT lang, array_to_string(ws[x:x + y - 1], ' ') AS sub, a FROM c JOIN q USING (k)),
d AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN s ON s.lang = c.lang AND s.sub = c.phrase WHERE 100 * s.a >= 80 * c.a),
u AS (SELECT lang, k, phrase, a, ws, unnest(range(1, k)) AS cut FROM c ANTI JOIN d USING (lang, phrase)),
v AS (SELECT u.lang, u.phrase, u.a, cut, l.f AS l, r.f AS r, (2000000 * u.a) // (l.f + r.f) AS score
      FROM u JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(ws[1:cut], ' ') JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(ws[cut + 1:], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM v),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b WHERE nth = 1)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM t JOIN n USING (lang) WHERE rank <= 2000"""


@query("op13_collocations", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aerocast.llm.collocations import mine_phrases, score_phrases, top_phrases
    phrases, sizes = mine_phrases(read(spark, sf_dir, "documents"))
    top = top_phrases(score_phrases(phrases, sizes))
    return top.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])


def periodic_tail(doc_id: int | None, n: int):
    """The contract's order of a document's n words: for one id in ten the words from a place on repeat with period p."""
    import zlib

    import numpy as np
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if doc_id is None or rest or not n:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate((np.arange(a), a + np.arange(n - a) % p))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aerocast.llm.periodic import collapse_runs
    found = collapse_runs(read(spark, sf_dir, "documents"), rearrange=periodic_tail)
    runs = F.col("runs")
    line = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    # runs are in order of start and period, so of equal exponents the first stays; compared as length * other period
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.aggregate(runs, F.lit(None).cast("struct<start: long, length: long, period: long>"), better)
    found = found.withColumn("best", best)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
                        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
