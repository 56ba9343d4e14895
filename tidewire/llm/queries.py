"""The registered queries of the operators of this package, over whole tables."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from tidewire.llm import bytecnn, collocations, maxscore, mixing, packing, periodic, pq, secrets, simhash, toxicity, vectors, vptree, warc, wavelet

QUERIES = {}
# Digests of tokenizers, models, trees and fingerprints are beyond SQL; tests hold these queries against plain versions.
ORACLES: dict[str, str] = {}

K = 20
TARGET_ENTROPY = 0.97  # of the largest possible


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark, folder: str, name: str):
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query
def op1_warc(spark, folder):
    archive = warc.write_archive(table(spark, folder, "pages"))
    return warc.read_archive(spark, archive, payloads=False)


@query
def op2_toxicity(spark, folder):
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))


@query
def op3_mixing(spark, folder):
    mixed = mixing.mix_sources(table(spark, folder, "documents"), target_entropy=TARGET_ENTROPY, relative=True)
    return mixing.mixed_order(mixed)


@query
def op4_wavelet(spark, folder):
    return wavelet.token_digests(wavelet.write_token_files(table(spark, folder, "documents")))


@query
def op5_quality(spark, folder):
    docs = table(spark, folder, "documents")
    return bytecnn.score(docs, bytecnn.fit(docs, table(spark, folder, "labels")))


@query
def op6_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents"))


@query
def op7_maxscore(spark, folder):
    rows = maxscore.quantize(table(spark, folder, "embeddings"))
    return maxscore.top_k(rows, rows.filter(F.col("vec_id") % 20 == 0), K)


@query
def op8_secrets(spark, folder):
    docs = table(spark, folder, "documents")
    return secrets.report(secrets.scan(docs, repository=F.concat_ws("/", "source", "lang")))


@query
def op9_vptree(spark, folder):
    rows = vectors.usable(table(spark, folder, "embeddings"), "vec_id", "embedding", zero=False)
    return vptree.nearest(rows, rows.filter(F.col("vec_id") % 20 == 0), K)


@query
def op10_simhash(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


# The plain way: every phrase of every piece, counted by its text.
_GRAMS = "SELECT lang, list_aggregate(w[i:i + {0} - 1], 'string_agg', ' ') AS g, count(*) AS f FROM (SELECT lang, w, unnest(range(1, len(w) - {0} + 2)) AS i FROM pieces) GROUP BY ALL"
OP11_SQL = f"""WITH pieces AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\\n\\x0B\\f\\r]')) AS piece FROM documents)),
one AS MATERIALIZED ({_GRAMS.format(1)}), two AS MATERIALIZED ({_GRAMS.format(2)}), three AS MATERIALIZED ({_GRAMS.format(3)}),
total AS (SELECT lang, sum(f) AS n FROM one GROUP BY lang),
parts AS (SELECT *, string_split(g, ' ') AS w FROM three WHERE f >= 10),
longer AS (SELECT lang, g, max(f) AS most FROM (SELECT lang, w[1] || ' ' || w[2] AS g, f FROM parts UNION ALL SELECT lang, w[2] || ' ' || w[3], f FROM parts) GROUP BY lang, g),
cuts AS (SELECT lang, g, f, 1 AS k, split_part(g, ' ', 1) AS x, split_part(g, ' ', 2) AS y FROM two LEFT JOIN longer USING (lang, g) WHERE f >= 10 AND 100 * coalesce(most, 0) < 50 * f
  UNION ALL SELECT lang, g, f, 1, w[1], w[2] || ' ' || w[3] FROM parts UNION ALL SELECT lang, g, f, 2, w[1] || ' ' || w[2], w[3] FROM parts),
phrases AS (SELECT * FROM one UNION ALL SELECT * FROM two),
scored AS (SELECT c.lang, c.g AS phrase, c.f AS a, p.f AS l, q.f AS r, k, CAST((1000000::HUGEINT * c.f * c.f) // (p.f::HUGEINT * q.f) AS BIGINT) AS score
  FROM cuts c JOIN phrases p ON p.lang = c.lang AND p.g = x JOIN phrases q ON q.lang = c.lang AND q.g = y),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest) JOIN total USING (lang)
WHERE rank <= 2000"""


@query
def op11_collocations(spark, folder):
    return collocations.collocations(table(spark, folder, "documents"))


ORACLES["op11_collocations"] = OP11_SQL


@query
def op12_pq(spark, folder):
    return pq.near_duplicates(table(spark, folder, "embeddings"))


# All pairs, and all that can be reached over them.
ORACLES["op12_pq"] = """WITH RECURSIVE rows AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
good AS MATERIALIZED (SELECT r, v FROM rows WHERE vec_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.r AS x, b.r AS y FROM good a JOIN good b ON a.r <> b.r AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
reached AS (SELECT r AS x, r AS y FROM rows UNION SELECT reached.x, links.y FROM reached JOIN links ON reached.y = links.x),
classes AS (SELECT x AS r, min(vec_id) AS component_id FROM reached JOIN rows ON rows.r = y GROUP BY x)
SELECT vec_id, (SELECT count(*) FROM links WHERE x = rows.r) AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept FROM rows JOIN classes USING (r)"""


def planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words that operator 13 looks at: a tenth of the texts repeat some of their words up to the end."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@query
def op13_periodic(spark, folder):
    found = periodic.periodic_runs(table(spark, folder, "documents"), rewrite=planted_period)
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        F.sha2(F.concat_ws("", F.transform("runs", line)), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
