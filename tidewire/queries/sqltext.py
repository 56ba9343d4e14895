"""DuckDB spellings of the text rules, for the oracles."""

from __future__ import annotations

from tidewire import defaults
from tidewire.functions import text as T
from tidewire.functions.text import element_pattern
from tidewire.queries.registry import quoted as q
from tidewire.queries.registry import quoted_list


BREAK_CLASS = r'''["«»“”„‘’`;@#$%&?!()\[\]{}<>]'''


def gsub(c: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({c}, {q(pattern)}, {q(by)}, 'g')"


def words(c: str) -> str:
    return f"regexp_extract_all(coalesce({c}, ''), {q(T.WORD)})"


def word_count(c: str) -> str:
    return f"len({words(c)})"


def strip(c: str) -> str:
    return gsub(c, T.EDGE_SPACE)


def unescape(c: str) -> str:
    entities = ", ".join(f"{q(k)}: {q(v)}" for k, v in defaults.ENTITIES.items())
    name = f"regexp_extract(s, {q(T.ENTITY_HEAD)}, 1)"
    number = (
        f"CASE WHEN {name} ILIKE '#x%' THEN TRY_CAST('0x' || substr({name}, 3) AS BIGINT) "
        f"WHEN {name} LIKE '#%' THEN TRY_CAST(substr({name}, 2) AS BIGINT) END"
    )
    char = (
        f"CASE WHEN {number} > 0 AND {number} < 1114112 AND {number} NOT BETWEEN 55296 AND 57343 "
        f"THEN chr(CAST({number} AS INTEGER)) ELSE MAP {{{entities}}}[{name}] END"
    )
    return (
        f"array_to_string(list_transform(string_split({c}, '&'), lambda s, i: CASE WHEN i = 1 THEN s "
        f"WHEN {char} IS NOT NULL THEN {char} || substr(s, length({name}) + 2) ELSE '&' || s END), '')"
    )


def strip_html(c: str) -> str:
    c = gsub(c, T.COMMENT)
    for name in ("script", "style", "template"):
        c = gsub(c, element_pattern(name))
    return unescape(gsub(c, T.TAG))


def no_short_words(c: str) -> str:
    return f"array_to_string(list_filter({words(c)}, lambda w: length(w) > 1), ' ')"


def tokens(c: str) -> str:
    c = gsub(gsub(gsub(c, BREAK_CLASS, " "), T.BREAK_RUN, " "), T.PAUSE, r" \2")
    c = f"' ' || {gsub(c, '[' + T.SPACES + ']+', '  ')} || '  '"
    c = gsub(f"({c})", T.CLITIC, "  ")
    for joined, parts in defaults.CONTRACTIONS.items():
        c = f"replace({c}, {q(' ' + joined + ' ')}, {q(' ' + parts + ' ')})"
    return words(c)


def letters_only(tokens_sql: str) -> str:
    return f"list_filter({tokens_sql}, lambda t: regexp_matches(t, {q(T.LETTERS)}))"


def no_stopwords(tokens_sql: str) -> str:
    return f"list_filter({tokens_sql}, lambda t: t NOT IN ({quoted_list(defaults.STOPWORDS)}))"


def lemma(t: str) -> str:
    table = ", ".join(f"{q(k)}: {q(v)}" for k, v in defaults.LEMMAS.items())
    return (
        f"CASE WHEN MAP {{{table}}}[{t}] IS NOT NULL THEN MAP {{{table}}}[{t}] "
        f"WHEN length({t}) < 4 OR NOT regexp_matches({t}, 's$') OR regexp_matches({t}, '(ss|us|is)$') THEN {t} "
        f"WHEN length({t}) > 4 AND {t} LIKE '%ies' THEN left({t}, -3) || 'y' "
        f"WHEN regexp_matches({t}, '(ss|x|z|ch|sh)es$') THEN left({t}, -2) "
        f"ELSE left({t}, -1) END"
    )


def lemmas(tokens_sql: str) -> str:
    return f"list_transform({tokens_sql}, lambda t: {lemma('t')})"


def clean_tokens(c: str) -> str:
    c = strip_html(f"coalesce({c}, '')")
    c = no_short_words(gsub(gsub(c, T.URL), T.EMAIL))
    return lemmas(no_stopwords(letters_only(tokens(f"lower({c})"))))


def clean_text(c: str) -> str:
    return f"array_to_string({clean_tokens(c)}, ' ')"
