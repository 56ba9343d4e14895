"""Duplicates, quality report and topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import minhash
from tidewire.functions.text import words
from tidewire.functions.urls import normalize_url
from tidewire.operators import dedup, neardup, simjoin, topics
from tidewire.queries import sqltext as S
from tidewire.queries.inputs import RAW_ARTICLES, plain, raw_articles
from tidewire.queries.registry import query
from tidewire.queries.textual import PARSED_AT
from tidewire.session import cut_lineage

P = minhash.PRIME


def signature_sql(id_col: str, source: str, k: int = minhash.PERMUTATIONS) -> str:
    """(id, sig): list of the least permuted hashes of the words of ``text`` in ``source``."""
    draw = lambda s: f"CAST('0x' || substr(md5({s}), 1, 8) AS BIGINT)"
    return f"""(SELECT {id_col}, list(v ORDER BY i) AS sig FROM (
      SELECT d.{id_col}, i, coalesce(min((a * h + b) % {P}), {P}) AS v
      FROM {source} d
      CROSS JOIN (SELECT i, {draw("'a' || i")} % {P - 1} + 1 AS a, {draw("'b' || i")} % {P} AS b FROM range({k}) r(i))
      LEFT JOIN (SELECT DISTINCT {id_col}, {draw('w')} % {P} AS h
                 FROM (SELECT {id_col}, unnest({S.words('text')}) AS w FROM {source})) USING ({id_col})
      GROUP BY d.{id_col}, i) GROUP BY {id_col})"""


def band_sql(id_col: str, source: str) -> str:
    """(id, band): one row per text and band."""
    return f"""(SELECT {id_col}, CAST(j AS VARCHAR) || ':' || array_to_string(list_slice(sig, j * 13 + 1, j * 13 + 13), ',') AS band
      FROM {signature_sql(id_col, source)}, range(9) g(j))"""


def greedy_sql(id_col: str, bands: str) -> str:
    """CTEs ending in ``kept``: texts taken one at a time, in order, unless a kept one shares a band."""
    return f"""bands AS MATERIALIZED (SELECT * FROM {bands}),
      rivals AS MATERIALIZED (SELECT y.{id_col} AS id, list(DISTINCT x.{id_col}) AS before FROM bands x JOIN bands y USING (band)
        WHERE x.{id_col} < y.{id_col} GROUP BY y.{id_col}),
      queue AS MATERIALIZED (SELECT id, before, row_number() OVER (ORDER BY id) AS turn FROM rivals),
      walk AS (SELECT CAST(0 AS BIGINT) AS turn, CAST([] AS BIGINT[]) AS dropped
        UNION ALL SELECT q.turn, CASE WHEN len(list_filter(q.before, lambda b: NOT list_contains(w.dropped, b))) > 0
          THEN list_append(w.dropped, q.id) ELSE w.dropped END
        FROM walk w JOIN queue q ON q.turn = w.turn + 1),
      dropped AS (SELECT unnest(dropped) AS id FROM (SELECT dropped FROM walk ORDER BY turn DESC LIMIT 1)),
      kept AS (SELECT DISTINCT {id_col} AS id FROM bands WHERE {id_col} NOT IN (SELECT id FROM dropped))"""


DOC_BANDS = band_sql("doc_id", "documents")


@query("scl29_minhash_signature", f"SELECT doc_id, md5(array_to_string(sig, ',')) AS digest FROM {signature_sql('doc_id', 'documents')}")
def _(t):
    signature = minhash.minhash_signature(F.col("text"))
    return t.documents.select("doc_id", F.md5(F.array_join(signature, ",")).alias("digest"))


def doc_bands(t):
    return cut_lineage(neardup.text_bands(t.documents, "doc_id", "text"))


@query("join4_lsh_collisions", f"""WITH bands AS MATERIALIZED (SELECT * FROM {DOC_BANDS}),
  firsts AS (SELECT band, min(doc_id) AS first FROM bands GROUP BY band)
  SELECT DISTINCT doc_id AS seq, first FROM bands JOIN firsts USING (band) WHERE doc_id <> first""")
def _(t):
    return neardup.collision_stars(cut_lineage(neardup.explode_bands(doc_bands(t))))


@query("win3_greedy_keep_first", f"WITH RECURSIVE {greedy_sql('doc_id', DOC_BANDS)} SELECT id AS doc_id FROM kept")
def _(t):
    return neardup.greedy_keep_first(doc_bands(t)).withColumnRenamed("seq", "doc_id")


@query("join5_jaccard_of_duplicates", f"""WITH RECURSIVE {greedy_sql('doc_id', DOC_BANDS)},
  pairs AS (SELECT y.doc_id AS seq, min(x.doc_id) AS kept_seq FROM bands x JOIN kept ON x.doc_id = kept.id JOIN bands y USING (band)
    WHERE x.doc_id < y.doc_id GROUP BY y.doc_id),
  sets AS (SELECT doc_id, list_distinct({S.words('text')}) AS k FROM documents)
  SELECT seq, kept_seq, round(len(list_intersect(a.k, b.k))::DOUBLE / len(list_distinct(list_concat(a.k, b.k))), 6) AS jaccard
  FROM pairs JOIN sets a ON a.doc_id = seq JOIN sets b ON b.doc_id = kept_seq""")
def _(t):
    bands = doc_bands(t)
    pairs = neardup.kept_partners(bands, neardup.greedy_keep_first(bands))
    texts = t.documents.select(F.col("doc_id").alias("seq"), F.array_distinct(words(F.col("text"))).alias("words"))
    found = neardup.pair_jaccard(pairs, texts, "seq", "kept_seq")
    return found.withColumn("jaccard", F.round("jaccard", 6))


# Every pair that shares a word, and all that can be reached over those at 0.8 or more.
SIMILAR = f"""WITH RECURSIVE sets AS MATERIALIZED (SELECT doc_id AS seq, list_distinct({S.words('text')}) AS k FROM documents),
  single AS MATERIALIZED (SELECT seq, len(k) AS n, unnest(k) AS w FROM sets),
  shared AS (SELECT a.seq AS x, b.seq AS y, a.n + b.n AS total, count(*) AS c FROM single a JOIN single b ON a.w = b.w AND a.seq < b.seq
    WHERE a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n GROUP BY ALL),
  pairs AS (SELECT x, y FROM shared WHERE c::DOUBLE / (total - c) >= 0.8
    UNION ALL SELECT a.seq, b.seq FROM sets a JOIN sets b ON len(a.k) = 0 AND len(b.k) = 0 AND a.seq < b.seq),
  links AS MATERIALIZED (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
  reached AS (SELECT seq AS x, seq AS y FROM sets UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x)
  SELECT x AS seq, (SELECT count(*) FROM links l WHERE l.x = r.x) AS n_links, min(y) AS class_id FROM reached r GROUP BY x"""


@query("join5_similar_texts", SIMILAR)
def _(t):
    return simjoin.similar_sets(t.documents.select("doc_id", words(F.col("text")).alias("words")), "doc_id", "words")


# --- keep-first by URL, cleaning stage -----------------------------------------------------------

RAW = plain(RAW_ARTICLES)
CLEAN_URL = """rtrim(regexp_replace(split_part(split_part(url, '#', 1), '?', 1), ';[^/]*$', ''), '/')"""
URL_PASS = f"""(SELECT seq, clean AS url, published_at, html FROM (SELECT *, row_number() OVER (PARTITION BY clean ORDER BY seq) AS r
  FROM (SELECT *, {CLEAN_URL} AS clean FROM ({RAW})) WHERE clean IS NOT NULL AND clean <> '') WHERE r = 1)"""


@query("win1_keep_first_by_url", f"SELECT seq, url FROM {URL_PASS}")
def _(t):
    rows = raw_articles(t).select("seq", normalize_url(F.col("url")).alias("url"))
    return dedup.keep_first(rows.filter("url <> ''"), "url", "seq")


@query("flt6_with_url", f"SELECT seq, {CLEAN_URL} AS url FROM ({RAW}) WHERE url IS NOT NULL AND url <> ''")
def _(t):
    rows = raw_articles(t).select("seq", normalize_url(F.col("url")).alias("url"))
    return rows.filter(F.coalesce("url", F.lit("")) != "")


@query("agg7_distinct_urls", f"SELECT DISTINCT {CLEAN_URL} AS url FROM ({RAW}) WHERE url IS NOT NULL AND url <> ''")
def _(t):
    rows = raw_articles(t).select(normalize_url(F.col("url")).alias("url"))
    return rows.filter("url <> ''").distinct()


# Documents as articles: every body under a URL, some URLs repeated, some bodies missing.
DOC_ARTICLES = """SELECT doc_id AS seq,
  CASE WHEN doc_id % 53 = 4 THEN '' ELSE 'https://' || source || '.example.org/' || CAST(doc_id - CASE WHEN doc_id % 19 = 18 THEN 1 ELSE 0 END AS STRING) || '/?id=7' END AS url,
  CASE doc_id % 4 WHEN 0 THEN '2024-03-05' WHEN 1 THEN '20240305T101112Z' WHEN 2 THEN 'soon' ELSE NULL END AS published_at,
  CASE doc_id % 61 WHEN 5 THEN '' WHEN 6 THEN NULL WHEN 7 THEN '   ' ELSE text END AS body
FROM {documents}"""
PASS = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clean ORDER BY seq) AS r
  FROM (SELECT *, {CLEAN_URL} AS clean FROM ({plain(DOC_ARTICLES)})) WHERE clean <> '') WHERE r = 1)"""
PASS_TEXT = f"(SELECT seq, body AS text FROM {PASS} WHERE coalesce(body, '') <> '')"
STG5 = f"WITH RECURSIVE {greedy_sql('seq', band_sql('seq', PASS_TEXT))}"
STG5_REPORT = f"""{STG5}
  SELECT (SELECT count(*) FROM documents) AS initial, (SELECT count(*) FROM documents) - count(*) AS url_duplicates,
    count(CASE WHEN coalesce(body, '') <> '' THEN 1 END) - (SELECT count(*) FROM kept) AS body_duplicates,
    count(CASE WHEN {PARSED_AT} IS NULL THEN 1 END) AS invalid_dates,
    count(CASE WHEN {S.word_count('body')} < 50 THEN 1 END) AS short_bodies, (SELECT count(*) FROM kept) AS final FROM {PASS}"""


def cleaned(t):
    from tidewire.plans.clean import clean_articles

    return clean_articles(t.sql(DOC_ARTICLES, "documents"))


@query("agg5_quality_counters", STG5_REPORT)
def _(t):
    return cleaned(t)[1]


@query("stg5_clean_articles", f"""{STG5}
  SELECT seq, clean AS url, strftime({PARSED_AT}, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS published_at, md5(body) AS digest
  FROM {PASS} JOIN kept ON kept.id = seq""")
def _(t):
    return cleaned(t)[0].select("seq", "url", "published_at", F.md5("body").alias("digest"))


@query("snk4_quality_report", f"""SELECT unnest(['Data Quality Report', '===================', 'Initial Articles: ' || initial,
    'Exact URL Duplicates Removed: ' || url_duplicates, 'MinHash Body Duplicates Removed: ' || body_duplicates,
    'Invalid/Unparseable Dates: ' || invalid_dates, 'Articles with <50 Words: ' || short_bodies,
    'Final Cleaned Articles: ' || final, '===================']) AS value FROM ({STG5_REPORT})""")
def _(t):
    from tidewire.session import scratch_path
    from tidewire.sinks.writers import write_report

    path = scratch_path(t.spark, "report")
    write_report(cleaned(t)[1], path)
    return t.spark.read.text(path)


# --- topics --------------------------------------------------------------------------------------

# The source of a document stands for its topic, numbered as clusters would be.
DOC_TOPICS = f"(SELECT doc_id, CAST(substr(source, 4) AS INTEGER) AS topic, {S.words('lower(text)')} AS tokens FROM documents)"
TERMS = f"""(SELECT topic, term, tf, tf * ln(1 + (SELECT count(*)::DOUBLE / count(DISTINCT topic) FROM (SELECT topic, unnest(tokens) AS x FROM {DOC_TOPICS}))
    / sum(tf) OVER (PARTITION BY term)) AS weight
  FROM (SELECT topic, term, count(*) AS tf FROM (SELECT topic, unnest(tokens) AS term FROM {DOC_TOPICS}) GROUP BY topic, term))"""
TOP = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank FROM {TERMS}) WHERE rank <= 3)"
LABELS = f"(SELECT topic, 'Topic_' || topic || '_' || string_agg(term, '_' ORDER BY rank) AS label FROM {TOP} GROUP BY topic)"


def doc_topics(t):
    return t.documents.select(
        "doc_id", F.substring("source", 4, 9).cast("int").alias("topic"), words(F.lower("text")).alias("tokens")
    )


def doc_terms(t):
    return topics.term_weights(doc_topics(t), "topic", "tokens")


@query("agg9_term_weights", f"SELECT topic, term, tf, round(weight, 6) AS weight FROM {TERMS}")
def _(t):
    return doc_terms(t).withColumn("weight", F.round("weight", 6))


@query("lim4_top_terms", f"SELECT topic, term, CAST(rank AS INTEGER) AS rank FROM {TOP}")
def _(t):
    return topics.top_terms(doc_terms(t)).select("topic", "term", "rank")


@query("scl30_topic_labels", f"SELECT topic, label FROM {LABELS}")
def _(t):
    return topics.topic_labels(topics.top_terms(doc_terms(t)))


@query("ml5_label_topics", f"SELECT doc_id, topic AS topic_id, label AS topic FROM {DOC_TOPICS} JOIN {LABELS} USING (topic)")
def _(t):
    ids = doc_topics(t).select("doc_id", F.col("topic").alias("topic_id"))
    return topics.label_topics(ids, topics.topic_labels(topics.top_terms(doc_terms(t))))


@query("join6_label_lookup", f"""SELECT doc_id, d.topic AS topic_id, coalesce(label, 'Unknown') AS topic
  FROM {DOC_TOPICS} d LEFT JOIN (SELECT * FROM {LABELS} WHERE topic < 10) l ON d.topic = l.topic""")
def _(t):
    ids = doc_topics(t).select("doc_id", F.col("topic").alias("topic_id"))
    labels = topics.topic_labels(topics.top_terms(doc_terms(t))).filter("topic < 10")
    return topics.label_topics(ids, labels)


@query("join7_documents_with_topics", f"SELECT doc_id, topic, md5(text) AS digest FROM documents JOIN {DOC_TOPICS} USING (doc_id)")
def _(t):
    ids = doc_topics(t).select("doc_id", "topic")
    return t.documents.join(ids, "doc_id").select("doc_id", "topic", F.md5("text").alias("digest"))


@query("agg8_topic_sizes", "SELECT lang AS topic, count(*) AS n FROM documents GROUP BY lang")
def _(t):
    return topics.topic_sizes(t.documents.withColumnRenamed("lang", "topic"), "topic")


@query("win4_topic_numbers", """SELECT doc_id, coalesce(CAST(place AS INTEGER), -1) AS topic_id FROM (SELECT doc_id, len(text) % 37 AS c FROM documents)
  LEFT JOIN (SELECT c, row_number() OVER (ORDER BY n DESC, c) - 1 AS place FROM (SELECT len(text) % 37 AS c, count(*) AS n FROM documents GROUP BY 1) WHERE n >= 26) USING (c)""")
def _(t):
    clustered = t.documents.select("doc_id", (F.length("text") % 37).alias("c"))
    return topics.number_topics(clustered, "c", min_topic_size=26).select("doc_id", "topic_id")


@query("ml3_document_vectors", f"SELECT doc_id, CASE WHEN len({S.words('lower(text)')}) > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS squared_length FROM documents")
def _(t):
    from pyspark.ml.functions import vector_to_array

    vectors = topics.tfidf_vectors(t.documents.select("doc_id", F.lower("text").alias("text")), "text")
    unit = F.aggregate(vector_to_array("vector"), F.lit(0.0), lambda s, x: s + x * x)
    return vectors.select("doc_id", F.round(unit, 6).alias("squared_length"))


@query("ml3_term_vectors", f"""SELECT doc_id, term, round(tf * ln(((SELECT count(*) FROM documents) + 1)::DOUBLE
    / (count(*) OVER (PARTITION BY term) + 1)), 6) AS weight
  FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM {DOC_TOPICS}) GROUP BY doc_id, term)""")
def _(t):
    vectors = topics.term_vectors(doc_topics(t), "doc_id", "tokens")
    return vectors.withColumn("weight", F.round("weight", 6))


# Vectors that differ by language alone, so the clusters are known.
LANGS = ("en", "de", "fr", "es")


def by_lang(t):
    flags = [(F.col("lang") == lang).cast("double") for lang in LANGS]
    return t.documents.select("doc_id", "text", F.array(*flags).alias("flags"))


BY_LANG = "(SELECT *, CASE WHEN lang IN ('en', 'de', 'fr', 'es') THEN lang ELSE '' END AS own FROM documents)"


@query("ml4_separable_clusters", f"""SELECT doc_id, min(doc_id) OVER (PARTITION BY own) AS first_doc,
  count(*) OVER (PARTITION BY own) AS members, rank() OVER (ORDER BY n DESC) - 1 AS larger_docs
  FROM (SELECT *, count(*) OVER (PARTITION BY own) AS n FROM {BY_LANG})""")
def _(t):
    """The topics are those of the languages, and numbered by falling size; ties may come in any order."""
    found = topics.assign_topics(topics.array_vectors(by_lang(t), "flags"), k=len(LANGS) + 1, min_topic_size=1)
    sizes = found.groupBy("topic_id").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("members"))
    larger = sizes.alias("a").join(sizes.alias("b"), (F.col("b.topic_id") < F.col("a.topic_id")) & (F.col("b.members") > F.col("a.members")), "left")
    place = larger.groupBy("a.topic_id", "a.first_doc", "a.members").agg(F.coalesce(F.sum("b.members"), F.lit(0)).alias("larger_docs"))
    return found.select("doc_id", "topic_id").join(place, "topic_id").drop("topic_id")


# Four far places, one for each language, and a spread around them; one text in 50 lies far outside of it.
SPREAD = """CASE WHEN doc_id % 50 = 7 THEN CASE WHEN doc_id % 100 = 7 THEN 40.0 ELSE -40.0 END ELSE (doc_id * 37 % 101 - 50) / 5.0 END"""


@query("ml4_planted_outliers", f"""WITH placed AS (SELECT doc_id, own, CAST({SPREAD} AS DOUBLE) AS z FROM {BY_LANG}),
  away AS (SELECT *, abs(z - avg(z) OVER (PARTITION BY own)) AS distance FROM placed),
  limits AS (SELECT own, 1.5 * quantile_disc(distance, 0.9) AS most FROM away GROUP BY own),
  judged AS (SELECT a.*, distance > most AS outlier FROM away a JOIN limits USING (own)),
  topics AS (SELECT own, min(doc_id) AS first_doc, count(*) AS members FROM judged WHERE NOT outlier GROUP BY own)
  SELECT doc_id, outlier, CASE WHEN NOT outlier THEN first_doc END AS first_doc, CASE WHEN NOT outlier THEN members END AS members
  FROM judged LEFT JOIN topics USING (own)""")
def _(t):
    """The number of clusters is found, too: it is that of the languages."""
    docs = by_lang(t).withColumn("flags", F.concat(F.transform("flags", lambda x: x * 1000), F.array(F.expr(f"CAST({SPREAD} AS DOUBLE)"))))
    found = topics.assign_topics(topics.array_vectors(docs, "flags"), k=range(2, 8), min_topic_size=1, outlier_quantile=0.9)
    sizes = found.filter(F.col("topic_id") >= 0).groupBy("topic_id").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("members"))
    return found.join(sizes, "topic_id", "left").select("doc_id", (F.col("topic_id") == topics.OUTLIER).alias("outlier"), "first_doc", "members")


@query("ml4_topic_clusters")
def _(t):
    return topics.assign_topics(topics.array_vectors(t.embeddings, "embedding"), k=8).select("vec_id", "topic_id")


LANG_WORDS = f"(SELECT own, unnest({S.words('lower(text)')}) AS term FROM {BY_LANG})"
LANG_TERMS = f"""(SELECT own, term, tf * ln(1 + (SELECT count(*)::DOUBLE / count(DISTINCT own) FROM {LANG_WORDS}) / sum(tf) OVER (PARTITION BY term)) AS weight
  FROM (SELECT own, term, count(*) AS tf FROM {LANG_WORDS} GROUP BY own, term))"""
LANG_LABELS = f"""(SELECT own, string_agg(term, '_' ORDER BY rank) AS label FROM (
  SELECT *, row_number() OVER (PARTITION BY own ORDER BY weight DESC, term) AS rank FROM {LANG_TERMS}) WHERE rank <= 3 GROUP BY own)"""


@query("stg7_separable_topics", f"""SELECT doc_id AS seq, md5(text) AS digest, min(doc_id) OVER (PARTITION BY own) AS first_doc, label
  FROM {BY_LANG} JOIN {LANG_LABELS} USING (own)""")
def _(t):
    """The whole stage on vectors with known clusters; the number in a label is left out, for sizes may tie."""
    from tidewire.plans.topics import model_topics

    docs = by_lang(t).select(
        F.col("doc_id").alias("seq"), "text", F.lower("text").alias("cleaned_body"), F.lit("").alias("headline"), "flags",
    )
    found = model_topics(docs, k=len(LANGS) + 1, min_topic_size=1, embedding="flags")
    first = found.groupBy("topic_id").agg(F.min("seq").alias("first_doc"))
    label = F.regexp_replace("topic", r"^Topic_\d+_", "").alias("label")
    return found.join(first, "topic_id").select("seq", F.md5("text").alias("digest"), "first_doc", label)


@query("stg7_model_topics")
def _(t):
    from tidewire.plans.topics import model_topics

    docs = t.documents.select(
        F.col("doc_id").alias("seq"), F.lower("text").alias("cleaned_body"), F.lit("").alias("headline")
    )
    return model_topics(docs, k=8).select("seq", "topic_id", "topic")
