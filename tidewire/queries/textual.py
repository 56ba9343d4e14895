"""Text cleaning, scalar rules and sentiment."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire import defaults
from tidewire.functions import dates, fields, scores, text, urls
from tidewire.operators import lexicon, scoring, wordtables
from tidewire.queries import sqltext as S
from tidewire.queries.inputs import RAW_ARTICLES, plain, raw_articles
from tidewire.queries.registry import query, quoted, quoted_list
from tidewire.sources.pages import page_text, page_title

# A body that holds what the documents lack: tags, a link, an address, clitics.
MARKED = """SELECT doc_id, '<p>Don''t cannot &eacute;t&#233; &amp;amp; ' || text || '</p><!-- x --><b>mail me@x.org</b> see http://a.b/c?d U.S. rates, 5,000 a e-mail, boxes cities' AS text
FROM {documents}"""
MARKED_SQL = f"({plain(MARKED)})"
CLEAN_DOCS = f"(SELECT doc_id, {S.clean_text('text')} AS cleaned FROM {MARKED_SQL})"


def marked(t):
    return t.sql(MARKED, "documents")


def _digest(c):
    return F.md5(c)


# --- one rule each -------------------------------------------------------------------------------

@query("scl1_normalize_url", """SELECT page_id, copy, rtrim(
    CASE WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))
      || substr(u, length(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) + 1) ELSE u END, '/') AS clean
  FROM (SELECT page_id, copy, regexp_replace(split_part(split_part(ltrim(url), '#', 1), '?', 1), ';[^/]*$', '') AS u
    FROM (SELECT page_id, 0 AS copy, url FROM pages UNION ALL SELECT page_id, 1, ' HTTP:' || substr(url, 6) || ';v=1?q=2' FROM pages
          UNION ALL SELECT page_id, 2, url || '///' FROM pages))""")
def _(t):
    rows = t.sql("""SELECT page_id, 0 AS copy, url FROM {pages} UNION ALL
      SELECT page_id, 1, ' HTTP:' || substr(url, 6) || ';v=1?q=2' FROM {pages} UNION ALL
      SELECT page_id, 2, url || '///' FROM {pages}""", "pages")
    return rows.select("page_id", "copy", urls.normalize_url(F.col("url")).alias("clean"))


RAW = plain(RAW_ARTICLES)
PARSED_AT = """coalesce(
    CASE WHEN published_at LIKE '%+02:00' THEN try_strptime(left(published_at, 19), '%Y-%m-%dT%H:%M:%S') - INTERVAL 2 HOUR END,
    try_strptime(published_at, '%Y%m%dT%H%M%SZ'), try_strptime(published_at, '%Y-%m-%d %H:%M'), try_strptime(published_at, '%Y-%m-%d'))"""


@query("scl2_normalize_date", f"""SELECT seq, strftime({PARSED_AT}, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso FROM ({RAW})""")
def _(t):
    return raw_articles(t).select("seq", dates.normalize_date(F.col("published_at")).alias("iso"))


@query("scl34_instant_or_null", f"SELECT seq, {PARSED_AT} AS at FROM ({RAW})")
def _(t):
    return raw_articles(t).select("seq", dates.parse_timestamp(F.col("published_at")).cast("timestamp_ntz").alias("at"))


@query("flt15_unreadable_dates", f"SELECT seq, {PARSED_AT} >= TIMESTAMP '2024-01-15' AS late FROM ({RAW}) WHERE {PARSED_AT} IS NOT NULL")
def _(t):
    at = dates.parse_timestamp(F.col("published_at"))
    return raw_articles(t).filter(at.isNotNull()).select("seq", (at >= F.lit("2024-01-15").cast("timestamp")).alias("late"))


@query("scl6_lower_case", "SELECT doc_id, md5(lower(text)) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", _digest(F.lower("text")).alias("digest"))


@query("scl7_contains_any", """SELECT doc_id, contains(lower(text), 'tion') AND contains(lower(text), 'que') AS both_found,
  contains(lower(text), 'ing the') OR contains(lower(text), 'eaux') AS any_found FROM documents""")
def _(t):
    low = F.lower("text")
    return t.documents.select(
        "doc_id", (text.contains_any(low, ["tion"]) & text.contains_any(low, ["que"])).alias("both_found"),
        text.contains_any(low, ["ing the", "eaux"]).alias("any_found"),
    )


@query("scl8_word_count", f"SELECT doc_id, {S.word_count('text')} AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", text.word_count(F.col("text")).alias("n"))


@query("scl9_model_input", "SELECT doc_id, md5(substr(text, 1, 2000)) AS digest, least(length(text), 2000) AS n FROM documents")
def _(t):
    cut = scoring.model_input(F.col("text"))
    return t.documents.select("doc_id", _digest(cut).alias("digest"), F.length(cut).alias("n"))


@query("scl10_strip_html", f"SELECT page_id, md5({S.strip_html('html')}) AS digest FROM pages")
def _(t):
    return t.pages.select("page_id", _digest(text.strip_html(F.col("html"))).alias("digest"))


@query("scl11_remove_urls", f"SELECT page_id, md5({S.gsub('html', text.URL)}) AS digest FROM pages")
def _(t):
    return t.pages.select("page_id", _digest(text.remove_urls(F.col("html"))).alias("digest"))


@query("scl12_remove_emails", f"SELECT doc_id, md5({S.gsub('text', text.EMAIL)}) AS digest FROM {MARKED_SQL}")
def _(t):
    return marked(t).select("doc_id", _digest(text.remove_emails(F.col("text"))).alias("digest"))


@query("scl13_drop_short_words", f"SELECT doc_id, md5({S.no_short_words('text')}) AS digest FROM {MARKED_SQL}")
def _(t):
    return marked(t).select("doc_id", _digest(text.drop_short_words(F.col("text"))).alias("digest"))


@query("scl14_tokenize", f"""SELECT doc_id, len(k) AS n, md5(array_to_string(k, ' ')) AS digest
  FROM (SELECT doc_id, {S.tokens('lower(text)')} AS k FROM {MARKED_SQL})""")
def _(t):
    k = text.tokenize(F.lower("text"))
    return marked(t).select("doc_id", F.size(k).alias("n"), _digest(F.array_join(k, " ")).alias("digest"))


@query("scl15_alphabetic", f"""SELECT doc_id, len(k) AS n, md5(array_to_string(k, ' ')) AS digest
  FROM (SELECT doc_id, {S.letters_only(S.words('text'))} AS k FROM documents)""")
def _(t):
    k = text.alphabetic(text.words(F.col("text")))
    return t.documents.select("doc_id", F.size(k).alias("n"), _digest(F.array_join(k, " ")).alias("digest"))


@query("scl16_stopwords", f"""SELECT doc_id, len(k) AS n, md5(array_to_string(k, ' ')) AS digest
  FROM (SELECT doc_id, {S.no_stopwords(S.words('lower(text)'))} AS k FROM documents)""")
def _(t):
    k = text.without_stopwords(text.words(F.lower("text")))
    return t.documents.select("doc_id", F.size(k).alias("n"), _digest(F.array_join(k, " ")).alias("digest"))


@query("scl17_lemmas", f"""SELECT doc_id, md5(array_to_string(k, ' ')) AS digest
  FROM (SELECT doc_id, {S.lemmas(S.words('lower(text)'))} AS k FROM {MARKED_SQL})""")
def _(t):
    k = text.lemmatize(text.words(F.lower("text")))
    return marked(t).select("doc_id", _digest(F.array_join(k, " ")).alias("digest"))


@query("scl18_join_tokens", f"SELECT doc_id, md5(array_to_string({S.words('text')}, ' ')) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", _digest(F.array_join(text.words(F.col("text")), " ")).alias("digest"))


@query("scl19_clean_text", f"SELECT doc_id, {S.word_count('cleaned')} AS n, md5(cleaned) AS digest FROM {CLEAN_DOCS}")
def _(t):
    cleaned = marked(t).select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))
    return cleaned.select("doc_id", text.word_count(F.col("cleaned")).alias("n"), _digest(F.col("cleaned")).alias("digest"))


# Labels and scores a model might give, made from the labelled documents.
GUESSES = """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN toxic = 1 THEN 'LABEL_0' WHEN quality = 1 THEN 'LABEL_2' ELSE 'LABEL_1' END AS label,
  CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 0.001 ELSE (doc_id % 100) / 100.0E0 END AS score FROM {labels}"""
SIGNED = f"""(SELECT doc_id, coalesce(CASE WHEN contains(label, '0') THEN -score WHEN contains(label, '2') THEN score END, 0.0::DOUBLE) AS model
  FROM ({plain(GUESSES)}))"""


@query("scl20_signed_label_score", f"SELECT doc_id, model FROM {SIGNED}")
def _(t):
    return t.sql(GUESSES, "labels").select(
        "doc_id", scores.signed_label_score(F.col("label"), F.col("score")).alias("model")
    )


def _scored_docs(t):
    model = scores.signed_label_score(F.col("label"), F.col("score"))
    guesses = t.sql(GUESSES, "labels").select("doc_id", model.alias("model"))
    return t.documents.join(guesses, "doc_id")


GUESSED = f"""(SELECT d.doc_id, model, text FROM documents d JOIN {SIGNED} s ON d.doc_id = s.doc_id)"""


@query("flt14_model_score_counts", f"SELECT doc_id, {S.word_count('text')} >= 20 AND abs(model) > 0.001 AS counts FROM {GUESSED}")
def _(t):
    return _scored_docs(t).select("doc_id", scores.model_score_counts(F.col("text"), F.col("model")).alias("counts"))


@query("scl21_composite_score", f"""SELECT doc_id, CASE WHEN {S.word_count('text')} >= 20 AND abs(model) > 0.001
  THEN model ELSE 0.25::DOUBLE END AS sentiment FROM {GUESSED}""")
def _(t):
    final = scores.composite_score(F.col("text"), F.col("model"), F.lit(0.25))
    return _scored_docs(t).select("doc_id", final.alias("sentiment"))


@query("scl32_quarter_hour", """SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts) AS quarter,
  strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y%m%d%H%M%S') AS slot FROM events""")
def _(t):
    quarter = dates.floor_quarter(F.col("ts").cast("timestamp"))
    return t.events.select("event_id", quarter.cast("timestamp_ntz").alias("quarter"), dates.slot_name(quarter).alias("slot"))


# --- filters on texts ----------------------------------------------------------------------------

@query("flt5_long_enough", """SELECT doc_id FROM documents WHERE length(text) > 100""")
def _(t):
    from tidewire.sources.pages import long_enough

    return t.documents.filter(long_enough(F.col("text"))).select("doc_id")


# Documents with some bodies missing, empty or blank.
GAPPED = """SELECT doc_id, CASE doc_id % 10 WHEN 3 THEN NULL WHEN 5 THEN '' WHEN 7 THEN '  ' ELSE text END AS body FROM {documents}"""


@query("flt7_with_body", f"SELECT doc_id FROM ({plain(GAPPED)}) WHERE body IS NOT NULL AND body <> ''")
def _(t):
    return t.sql(GAPPED, "documents").filter(F.coalesce("body", F.lit("")) != "").select("doc_id")


@query("flt13_scorable", f"SELECT doc_id, md5(substr(body, 1, 2000)) AS digest FROM ({plain(GAPPED)}) WHERE trim(body) <> ''")
def _(t):
    rows = t.sql(GAPPED, "documents").withColumn("fed", scoring.scorable(F.col("body"), F.col("body")))
    return rows.filter("fed IS NOT NULL").select("doc_id", _digest(F.col("fed")).alias("digest"))


@query("prj5_default_values", f"SELECT doc_id, coalesce(body, '') = '' AS missing, length(coalesce(body, '')) AS n FROM ({plain(GAPPED)})")
def _(t):
    body = F.coalesce("body", F.lit(""))
    return t.sql(GAPPED, "documents").select("doc_id", (body == "").alias("missing"), F.length(body).alias("n"))


@query("prj7_topic_text", f"""SELECT doc_id, md5(CASE WHEN trim(coalesce(body, '')) <> '' THEN body ELSE 'Headline ' || doc_id END) AS digest
  FROM ({plain(GAPPED)})""")
def _(t):
    from tidewire.operators.topics import topic_text

    headline = F.concat(F.lit("Headline "), F.col("doc_id").cast("string"))
    return t.sql(GAPPED, "documents").select("doc_id", _digest(topic_text(F.col("body"), headline)).alias("digest"))


@query("join9_without_stopwords", f"""SELECT doc_id, count(*) AS n, count(DISTINCT w) AS n_distinct FROM (
  SELECT doc_id, unnest({S.words('lower(text)')}) AS w FROM documents) WHERE w NOT IN ({quoted_list(defaults.STOPWORDS)}) GROUP BY doc_id""")
def _(t):
    tokens = t.documents.select("doc_id", F.explode(text.words(F.lower("text"))).alias("w"))
    stop = t.spark.createDataFrame([(w,) for w in defaults.STOPWORDS], "w string")
    kept = tokens.join(F.broadcast(stop), "w", "left_anti")
    return kept.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("w").alias("n_distinct"))


# --- lexicon sentiment ---------------------------------------------------------------------------

# The documents are invented prose, so the lists are drawn from their frequent words.
WORDS = {"the": 0.5, "is": 1.2, "for": 2.1, "est": -0.8, "und": -1.4, "with": -1.9, "que": 0.9, "el": -0.6, "that": 1.7}
BOOSTERS = {"of": 0.293, "and": -0.293, "les": 0.293, "ist": -0.293}
NEGATIONS = ["not", "in", "der", "la"]
LEXICON_SQL = "(VALUES " + ", ".join(f"({quoted(w)}, {v}::DOUBLE)" for w, v in WORDS.items()) + ") AS l(entry, valence)"
BOOST_SQL = "CASE {c} " + " ".join(f"WHEN {quoted(w)} THEN {v}" for w, v in BOOSTERS.items()) + " ELSE 0.0 END"

BARE = r"'^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+\z'"
BARE_WORDS = f"""list_transform({S.words('text')}, lambda w: CASE WHEN length(regexp_replace(w, {BARE}, '', 'g')) <= 2
  THEN w ELSE regexp_replace(w, {BARE}, '', 'g') END)"""
CONTEXT = f"""(SELECT doc_id, pos, token, lag(token, 1) OVER o AS prev1, lag(token, 2) OVER o AS prev2, lag(token, 3) OVER o AS prev3
  FROM (SELECT doc_id, unnest({BARE_WORDS}) AS token, unnest(range(len({S.words('text')}))) AS pos FROM documents)
  WINDOW o AS (PARTITION BY doc_id ORDER BY pos))"""


@query("join8_lexicon_lookup", f"""SELECT doc_id, count(*) AS hits, round(sum(valence), 4) AS total FROM {CONTEXT} c
  JOIN {LEXICON_SQL} ON lower(token) = entry GROUP BY doc_id""")
def _(t):
    entries = t.spark.createDataFrame(list(WORDS.items()), "token string, valence double")
    valued = lexicon.token_valences(lexicon.token_table(t.documents, "doc_id", "text"), entries).filter("valence <> 0")
    return valued.groupBy("doc_id").agg(F.count("*").alias("hits"), F.round(F.sum("valence"), 4).alias("total"))


@query("win5_token_context", f"""SELECT doc_id, count(*) AS n, count(CASE WHEN lower(prev1) IN ({quoted_list(NEGATIONS)}) THEN 1 END) AS n1,
    count(CASE WHEN lower(prev2) IN ({quoted_list(NEGATIONS)}) THEN 1 END) AS n2,
    count(CASE WHEN lower(prev3) IN ({quoted_list(NEGATIONS)}) THEN 1 END) AS n3 FROM {CONTEXT} GROUP BY doc_id""")
def _(t):
    rows = lexicon.token_table(t.documents, "doc_id", "text")
    negated = [F.count_if(F.lower(f"prev{k}").isin(NEGATIONS)).alias(f"n{k}") for k in (1, 2, 3)]
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), *negated)


def _step(v: str, k: int, damp: float) -> str:
    low = f"lower(prev{k})"
    shout = f"CASE WHEN mixed AND prev{k} = upper(prev{k}) AND prev{k} <> lower(prev{k}) AND {BOOST_SQL.format(c=low)} <> 0 THEN 0.733 ELSE 0 END"
    push = f"({BOOST_SQL.format(c=low)} + {shout})"
    flip = f"CASE WHEN {low} IN ({quoted_list(NEGATIONS)}) OR contains({low}, 'n''t') THEN -0.74 ELSE 1 END"
    return (f"CASE WHEN prev{k} IS NULL OR {low} IN ({quoted_list(WORDS)}) THEN {v} "
            f"ELSE ({v} + sign({v}) * {push} * {damp}) * {flip} END")


ML1 = f"""
WITH shouting AS (SELECT doc_id, count(CASE WHEN token = upper(token) AND token <> lower(token) THEN 1 END) AS s, count(*) AS n,
    min(CASE WHEN lower(token) = 'but' THEN pos END) AS but_at FROM {CONTEXT} GROUP BY doc_id),
hits AS (SELECT c.*, s > 0 AND s < n AS mixed, but_at,
    valence + CASE WHEN s > 0 AND s < n AND token = upper(token) AND token <> lower(token) THEN sign(valence) * 0.733 ELSE 0 END AS v0
  FROM {CONTEXT} c JOIN {LEXICON_SQL} ON lower(token) = entry JOIN shouting USING (doc_id)),
v1 AS (SELECT *, {_step('v0', 1, 1.0)} AS w1 FROM hits),
v2 AS (SELECT *, {_step('w1', 2, 0.95)} AS w2 FROM v1),
v3 AS (SELECT *, {_step('w2', 3, 0.9)} * CASE WHEN but_at IS NULL OR pos = but_at THEN 1 WHEN pos < but_at THEN 0.5 ELSE 1.5 END AS w3 FROM v2),
total AS (SELECT doc_id, sum(w3) AS s FROM v3 GROUP BY doc_id),
marks AS (SELECT doc_id, coalesce(s, 0) AS s, least(length(text) - length(replace(text, '!', '')), 4) * 0.292 +
    CASE WHEN length(text) - length(replace(text, '?', '')) <= 1 THEN 0
         WHEN length(text) - length(replace(text, '?', '')) <= 3 THEN (length(text) - length(replace(text, '?', ''))) * 0.18
         ELSE 0.96 END AS e FROM documents LEFT JOIN total USING (doc_id))
SELECT doc_id, round((s + sign(s) * e) / sqrt(pow(s + sign(s) * e, 2) + 15), 3) AS compound FROM marks"""


@query("ml1_lexicon_score", ML1)
def _(t):
    score = lexicon.lexicon_score(F.col("text"), WORDS, BOOSTERS, NEGATIONS, places=9)
    return t.documents.select("doc_id", F.round(score, 3).alias("compound"))


@query("ml1_lexicon_table", ML1)
def _(t):
    """The same by a table that is joined, however large it is."""
    entries = t.spark.createDataFrame(list(WORDS.items()), "token string, valence double")
    scored = lexicon.score_by_table(t.documents, "doc_id", "text", entries, "compound", BOOSTERS, NEGATIONS, places=9)
    return scored.select("doc_id", F.round("compound", 3).alias("compound"))


SINGULAR = " ".join(f"UNION ALL SELECT w, left(w, length(w) - {len(end)}) || '{put}' FROM vocabulary WHERE ends_with(w, '{end}')" for end, put in wordtables.PLURALS)


@query("scl17_dictionary_lemmas", f"""WITH tokens AS MATERIALIZED (SELECT doc_id, {S.words('lower(text)')} AS k FROM documents),
  vocabulary AS MATERIALIZED (SELECT unnest(k) AS w, count(*) AS n FROM tokens GROUP BY 1),
  forms AS (SELECT w, w AS form FROM vocabulary {SINGULAR}),
  best AS (SELECT w, form FROM forms WHERE form IN (SELECT w FROM vocabulary WHERE n >= 5) QUALIFY row_number() OVER (PARTITION BY w ORDER BY length(form), form) = 1),
  placed AS (SELECT doc_id, unnest(k) AS w, unnest(range(len(k))) AS pos FROM tokens),
  lemmas AS (SELECT doc_id, string_agg(coalesce(form, p.w), ' ' ORDER BY pos) AS line FROM placed p LEFT JOIN best b ON b.w = p.w GROUP BY doc_id)
  SELECT doc_id, md5(coalesce(line, '')) AS digest FROM tokens LEFT JOIN lemmas USING (doc_id)""")
def _(t):
    """Singular forms that the corpus itself has at least five times."""
    tokens = t.documents.select("doc_id", text.words(F.lower("text")).alias("tokens"))
    nouns = wordtables.corpus_nouns(tokens.select(F.explode("tokens").alias("word")))
    found = wordtables.lemmatize_by_table(tokens, "doc_id", "tokens", nouns)
    return found.select("doc_id", F.md5(F.array_join("tokens", " ")).alias("digest"))


# --- model scoring -------------------------------------------------------------------------------

def _toy_scorer():
    """A stand-in model: label by the share of vowels. It fails on texts that start with a digit."""

    def score(texts):
        out = []
        for s in texts:
            if s[:1].isdigit():
                raise ValueError("cannot score")
            share = sum(s.count(v) for v in "aeiou") / len(s)
            out.append(("LABEL_0" if share < 0.3 else "LABEL_2" if share > 0.4 else "LABEL_1", share))
        return out

    return score


VOWELS = " + ".join(f"(length(s) - length(replace(s, '{v}', '')))" for v in "aeiou")


@query("udf2_model_per_text", f"""SELECT doc_id, CASE WHEN regexp_matches(s, '^[0-9]') THEN 0.0
    WHEN share < 0.3 THEN -round(share, 6) WHEN share > 0.4 THEN round(share, 6) ELSE 0.0 END AS model
  FROM (SELECT doc_id, s, ({VOWELS})::DOUBLE / length(s) AS share FROM (
    SELECT doc_id, substr(CASE WHEN doc_id % 9 = 0 THEN '7' || text ELSE text END, 1, 2000) AS s FROM documents))""")
def _(t):
    body = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("7"), F.col("text"))).otherwise(F.col("text"))
    scored = t.documents.select("doc_id", scoring.batch_label_score(scoring.model_input(body), _toy_scorer).alias("r"))
    return scored.select("doc_id", F.round(scores.signed_label_score(F.col("r.label"), F.col("r.score")), 6).alias("model"))


@query("ml2_label_flags", "SELECT doc_id, true AS known_label, true AS in_range FROM documents")
def _(t):
    """The bundled model's labels and scores, checked for their form only: which label a text gets is beyond SQL."""
    model = scoring.default_scorer(t.documents.join(t.labels, "doc_id"), "text", "quality")
    scored = scoring.apply_default_scorer(model, t.documents.select("doc_id", "text"), "text")
    known = F.col("label").isin("LABEL_0", "LABEL_2").alias("known_label")
    return scored.select("doc_id", known, F.col("score").between(0.5, 1.0).alias("in_range"))


@query("ml2_model_score")
def _(t):
    labelled = t.documents.join(t.labels, "doc_id")
    model = scoring.default_scorer(labelled, "text", "quality")
    fed = t.documents.select("doc_id", scoring.model_input(F.col("text"), None).alias("model_input"))
    scored = scoring.apply_default_scorer(model, fed, "model_input")
    return scored.select("doc_id", "label", F.round("score", 6).alias("score"))


STG6 = f"""SELECT doc_id, n, lexicon, model, CASE WHEN n >= 20 AND abs(model) > 0.001 THEN model ELSE lexicon END AS sentiment FROM (
  SELECT doc_id, {S.word_count('cleaned')} AS n, round((w * 1.9) / sqrt(pow(w * 1.9, 2) + 15), 3) AS lexicon,
    CASE WHEN trim(cleaned) = '' OR regexp_matches(s, '^[0-9]') THEN 0.0 WHEN share < 0.3 THEN -round(share, 6) WHEN share > 0.4 THEN round(share, 6) ELSE 0.0 END AS model
  FROM (SELECT doc_id, {S.clean_text('text')} AS cleaned, doc_id % 3 AS w, substr(text, 1, 2000) AS s FROM documents),
    LATERAL (SELECT ({VOWELS})::DOUBLE / length(s) AS share))"""


@query("stg6_score_articles", STG6)
def _(t):
    from tidewire.plans.nlp import score_articles

    headline = F.concat(F.lit("Report"), F.repeat(F.lit(" good"), (F.col("doc_id") % 3).cast("int")))
    docs = t.documents.select("doc_id", F.col("text").alias("body"), headline.alias("headline"))
    scored = score_articles(docs, _toy_scorer)
    return scored.select(
        "doc_id", text.word_count(F.col("cleaned_body")).alias("n"), F.round("vader_score", 3).alias("lexicon"),
        F.round("transformer_score", 6).alias("model"),
        F.when(F.col("sentiment_score") == F.col("transformer_score"), F.round("sentiment_score", 6))
        .otherwise(F.round("sentiment_score", 3)).alias("sentiment"),
    )
