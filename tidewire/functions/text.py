"""Text expressions: words, HTML removal, tokens, and the combined cleaning rule.

Patterns avoid look-around and back-references, so they cost linear time and
mean the same in other regular-expression engines.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire import defaults
from tidewire.functions.lookup import bind, dict_lookup

# White space as Python's str.split() understands it (Unicode, not just ASCII).
SPACES = (
    r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE_CHARS = "".join(
    chr(i)
    for lo, hi in [(0x9, 0xD), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
                   (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
    for i in range(lo, hi + 1)
)
WORD = f"[^{SPACES}]+"
EDGE_SPACE = f"^[{SPACES}]+|[{SPACES}]+\\z"

COMMENT = r"(?s)<!--.*?(?:-->|\z)"
TAG = r"<[/!?]?[A-Za-z][^>]*>"
URL = f"(?:http|www){WORD}"
EMAIL = f"{WORD}@{WORD}"
# The same, tried at word starts only: elsewhere it could just rescan the word.
EMAIL_AT_WORD_START = f"(?<!{WORD[:-1]}){EMAIL}"
ENTITY_HEAD = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"

# Characters and runs that stand as tokens of their own next to a word.
BREAK_CHARS = '"«»“”„‘’`;@#$%&?!()[]{}<>'
BREAK_RUN = r"--+|\.\.+"
PAUSE = r"([,:])([^0-9])"
CLITIC = r"(n't|'s|'m|'d|'ll|'re|'ve|'|[.,:]) "
LETTERS = r"^\p{L}+$"


def element_pattern(name: str) -> str:
    """Pattern of an HTML element with all it contains."""
    return rf"(?is)<{name}(?:[ \t\r\n/][^>]*)?>.*?(?:</{name}[ \t\r\n]*>|\z)"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGE_SPACE, "")


def is_blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(WORD)


def _blank_out(c: Column, chars: str) -> Column:
    return F.translate(c, chars, " " * len(chars))


def _has_any(c: Column, needles: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(n)) for n in needles])


def plain_spaces(c: Column) -> Column:
    """Every kind of white space as a blank."""
    return _blank_out(c, SPACE_CHARS)


def _split_blanks(c: Column) -> Column:
    return F.array_remove(F.split(c, " ", -1), "")


def words(c: Column) -> Column:
    """White-space words in order."""
    return _split_blanks(plain_spaces(F.coalesce(c, F.lit(""))))


def word_count(c: Column) -> Column:
    return F.size(words(c))


def contains_any(c: Column, needles: Sequence[str]) -> Column:
    """True when ``c`` contains one of the literal ``needles``.

    One pattern rather than a chain of comparisons, which for a long list
    outgrows the size a compiled method may have.
    """
    return c.rlike("|".join(rf"\Q{needle}\E" for needle in needles))


def _character(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def unescape_html(c: Column, entities: Mapping[str, str] = defaults.ENTITIES) -> Column:
    """Replace character references, each exactly once, left to right."""

    def piece(part: Column, i: Column) -> Column:
        name = F.regexp_extract(part, ENTITY_HEAD, 1)
        code = F.when(
            F.lower(name).startswith("#x"), F.conv(F.substring(name, 3, 8), 16, 10).cast("long")
        ).when(name.startswith("#"), F.substring(name, 2, 8).cast("long"))
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        char = F.when(valid, _character(code)).otherwise(dict_lookup(name, entities, "string"))
        rest = F.substr(part, F.length(name) + F.lit(2))
        decoded = F.when(char.isNotNull(), F.concat(char, rest)).otherwise(F.concat(F.lit("&"), part))
        return F.when(i == 0, part).otherwise(decoded)

    decoded = F.array_join(F.transform(F.split(c, "&", -1), piece), "")
    return F.when(F.contains(c, F.lit("&")), decoded).otherwise(c)


def strip_html(c: Column) -> Column:
    """Visible text of a fragment, with nothing put in place of the tags."""

    def without_tags(text: Column) -> Column:
        out = F.regexp_replace(text, COMMENT, "")
        for name in ("script", "style", "template"):
            out = F.regexp_replace(out, element_pattern(name), "")
        return F.when(F.contains(text, F.lit("<")), F.regexp_replace(out, TAG, "")).otherwise(text)

    return bind(bind(c, without_tags), lambda text: unescape_html(text))


def remove_urls(c: Column) -> Column:
    return F.when(_has_any(c, ("http", "www")), F.regexp_replace(c, URL, "")).otherwise(c)


def remove_emails(c: Column) -> Column:
    return F.regexp_replace(c, EMAIL_AT_WORD_START, "")


def drop_short_words(c: Column) -> Column:
    """Drop one-character words and put single blanks between the others."""
    return F.array_join(F.filter(words(c), lambda w: F.length(w) > 1), " ")


def tokenize(c: Column) -> Column:
    """Tokens of lower-cased text: punctuation and clitics are split off and left out.

    Blanks are doubled so that neighbouring tokens never share a delimiter.
    """
    def without_runs(text: Column) -> Column:
        return F.when(_has_any(text, ("--", "..")), F.regexp_replace(text, BREAK_RUN, " ")).otherwise(text)

    text = bind(_blank_out(c, SPACE_CHARS + BREAK_CHARS), without_runs)
    text = F.regexp_replace(text, PAUSE, " $2")
    text = F.concat(F.lit(" "), F.replace(text, F.lit(" "), F.lit("  ")), F.lit("  "))
    # Few characters can begin a clitic: one look spares the choices.
    text = F.regexp_replace(text, f"(?=[n'.,:]){CLITIC}", "  ")

    def split_joined(text: Column) -> Column:
        out = text
        for joined, parts in defaults.CONTRACTIONS.items():
            out = F.replace(out, F.lit(f" {joined} "), F.lit(f" {parts} "))
        # Most texts have none of them: one look spares a pass for each.
        return F.when(_has_any(text, list(defaults.CONTRACTIONS)), out).otherwise(text)

    return _split_blanks(bind(text, split_joined))


def alphabetic(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t.rlike(LETTERS))


def without_stopwords(tokens: Column, stopwords: Sequence[str] = defaults.STOPWORDS) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(list(stopwords)))


def lemma(token: Column, lemmas: Mapping[str, str] = defaults.LEMMAS) -> Column:
    """Singular form of a noun: table first, then plural suffixes."""
    n = F.length(token)

    def cut(k: int, tail: str = "") -> Column:
        stem = F.substr(token, F.lit(1), n - F.lit(k))
        return F.concat(stem, F.lit(tail)) if tail else stem

    keep = token.endswith("ss") | token.endswith("us") | token.endswith("is") | (n < 4)
    by_rule = (
        F.when(~token.endswith("s") | keep, token)
        .when(token.endswith("ies") & (n > 4), cut(3, "y"))
        .when(
            token.endswith("sses") | token.endswith("xes") | token.endswith("zes")
            | token.endswith("ches") | token.endswith("shes"),
            cut(2),
        )
        .otherwise(cut(1))
    )
    return F.coalesce(dict_lookup(token, lemmas, "string"), by_rule) if lemmas else by_rule


def lemmatize(tokens: Column, lemmas: Mapping[str, str] = defaults.LEMMAS) -> Column:
    return F.transform(tokens, lambda t: lemma(t, lemmas))


def clean_tokens(
    c: Column,
    stopwords: Sequence[str] = defaults.STOPWORDS,
    lemmas: Mapping[str, str] = defaults.LEMMAS,
) -> Column:
    """HTML, URLs, e-mails, short words out; lower; tokens; letters only; no stopwords; lemmas."""
    text = bind(strip_html(F.coalesce(c, F.lit(""))), remove_urls)
    # A word with an inner @ is exactly what the e-mail pattern removes.
    plain = F.filter(words(text), lambda w: (F.length(w) > 1) & ~(F.contains(w, F.lit("@")) & w.rlike(".@.")))
    text = F.array_join(plain, " ")
    stop = list(stopwords)
    kept = F.filter(tokenize(F.lower(text)), lambda t: t.rlike(LETTERS) & ~t.isin(stop))
    return lemmatize(kept, lemmas)


def clean_text(
    c: Column,
    stopwords: Sequence[str] = defaults.STOPWORDS,
    lemmas: Mapping[str, str] = defaults.LEMMAS,
) -> Column:
    return F.array_join(clean_tokens(c, stopwords, lemmas), " ")
