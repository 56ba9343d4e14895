"""Lists and constants that decide results, and caller-replaceable defaults."""

from __future__ import annotations

# Topic keywords of the bulk feed.
BULK_KEYWORDS = [
    "federal reserve", "interest rate", "inflation", "fed",
    "election", "vote", "congress", "senate",
    "nvidia", "tech stock", "nasdaq", "artificial intelligence",
    "recession", "gdp", "unemployment", "economy",
    "tariff", "trade war", "climate", "healthcare",
    "oil price", "crypto", "bitcoin", "housing market",
]

# Topic keywords of the historical windows.
HISTORICAL_KEYWORDS = [
    "federal reserve", "interest rate", "inflation", "fed",
    "election", "vote", "congress", "senate",
    "nvidia", "tech stock", "nasdaq", "artificial intelligence",
    "recession", "gdp", "unemployment", "economy",
]

# Event anchors of the two studies.
EVENTS = [
    ("US Elections Nov", "2024-11-05"),
    ("Fed Rate Cut Sept", "2024-09-18"),
    ("Tech Stock Crash August", "2024-08-05"),
]

# Historical collection windows, both ends included.
WINDOWS = [
    ("Tech Sell-off", "20240725000000", "20240815000000"),
    ("Fed Rate Cut", "20240910000000", "20241001000000"),
    ("Election Window", "20241025000000", "20241115000000"),
]

# Columns of the exported article table, in order.
EXPORT_COLUMNS = [
    "url", "source", "headline", "published_at", "topic",
    "sentiment_score", "vader_score", "transformer_score",
]

# Field texts that pandas reads as missing.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]

# English stopwords (the list shipped with NLTK).
STOPWORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself "
    "yourselves he him his himself she she's her hers herself it it's its itself they them their "
    "theirs themselves what which who whom this that that'll these those am is are was were be been "
    "being have has had having do does did doing a an the and but if or because as until while of at "
    "by for with about against between into through during before after above below to from up down "
    "in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don "
    "don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn "
    "doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn "
    "needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()

# One-word contractions and the two tokens each stands for.
CONTRACTIONS = {
    "cannot": "can not", "gimme": "gim me", "gonna": "gon na",
    "gotta": "got ta", "lemme": "lem me", "wanna": "wan na",
}

# Irregular English plurals looked up before the suffix rules.
LEMMAS = {
    "men": "man", "women": "woman", "children": "child", "feet": "foot", "teeth": "tooth",
    "geese": "goose", "mice": "mouse", "lives": "life", "wives": "wife", "knives": "knife",
    "leaves": "leaf", "halves": "half", "shelves": "shelf", "wolves": "wolf", "thieves": "thief",
    "crises": "crisis", "analyses": "analysis", "theses": "thesis", "bases": "basis",
    "criteria": "criterion", "phenomena": "phenomenon", "oxen": "ox", "series": "series",
    "species": "species", "news": "news", "movies": "movie", "ties": "tie", "pies": "pie",
} | {
    # Words in -s that are no plurals, or have no singular of the same meaning.
    word: word for word in (
        "politics economics physics mathematics statistics ethics athletics mechanics electronics dynamics logistics genetics "
        "robotics analytics metrics olympics graphics classics tactics "
        "always perhaps sometimes towards besides afterwards whereas nowadays indeed "
        "texas christmas paris james charles jones thomas kansas arkansas illinois massachusetts los wales athens brussels naples "
        "lens headquarters means gas alias canvas chaos atlas bias christ pants scissors trousers goods thanks congratulations "
        "was has does his its this as yes us plus".split()
    )
}

# Named character references understood when unescaping HTML.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ",
    "copy": "©", "reg": "®", "trade": "™", "hellip": "…", "mdash": "—",
    "ndash": "–", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
    "laquo": "«", "raquo": "»", "bull": "•", "middot": "·", "euro": "€",
    "pound": "£", "yen": "¥", "cent": "¢", "sect": "§", "deg": "°",
    "agrave": "à", "aacute": "á", "acirc": "â", "auml": "ä", "aring": "å",
    "aelig": "æ", "ccedil": "ç", "egrave": "è", "eacute": "é", "ecirc": "ê",
    "euml": "ë", "iacute": "í", "icirc": "î", "iuml": "ï", "ntilde": "ñ",
    "oacute": "ó", "ocirc": "ô", "ouml": "ö", "oslash": "ø", "uacute": "ú",
    "ucirc": "û", "uuml": "ü", "szlig": "ß", "Eacute": "É", "Auml": "Ä",
    "Ouml": "Ö", "Uuml": "Ü",
}

# Words that flip the valence of one of the next three words.
NEGATIONS = (
    "aint arent cannot cant couldnt darent didnt doesnt ain't aren't can't couldn't daren't didn't "
    "doesn't dont hadnt hasnt havent isnt mightnt mustnt neither don't hadn't hasn't haven't isn't "
    "mightn't mustn't neednt needn't never none nope nor not nothing nowhere oughtnt shant shouldnt "
    "uhuh wasnt werent oughtn't shan't shouldn't uh-uh wasn't weren't without wont wouldnt won't "
    "wouldn't rarely seldom despite"
).split()

# Degree words, strengthening (+0.293) or weakening (-0.293).
_STRONGER = (
    "absolutely amazingly awfully completely considerable considerably decidedly deeply effing "
    "enormous enormously entirely especially exceptional exceptionally extreme extremely fabulously "
    "flipping flippin frackin fracking fricking frickin frigging friggin fully fuckin fucking fuggin "
    "fugging greatly hella highly hugely incredible incredibly intensely major majorly more most "
    "particularly purely quite really remarkably so substantially thoroughly total totally "
    "tremendous tremendously uber unbelievably unusually utter utterly very"
).split()
_WEAKER = (
    "almost barely hardly kinda kindof kind-of less little marginal marginally occasional "
    "occasionally partly scarce scarcely slight slightly somewhat sorta sortof sort-of"
).split()
BOOSTERS = {**{w: 0.293 for w in _STRONGER}, **{w: -0.293 for w in _WEAKER}}

# Small starter lexicon; pass the full published table in real use.
LEXICON = {
    "good": 1.9, "great": 3.1, "best": 3.2, "better": 1.9, "strong": 2.3, "gain": 2.4,
    "gains": 1.4, "growth": 1.6, "win": 2.8, "wins": 2.7, "success": 2.7, "successful": 2.8,
    "happy": 2.7, "hope": 1.9, "love": 3.2, "positive": 2.6, "profit": 1.9, "improve": 1.9,
    "safe": 1.9, "peace": 2.5, "bad": -2.5, "worse": -2.1, "worst": -3.1, "weak": -1.9,
    "loss": -1.3, "losses": -1.7, "lose": -1.7, "crash": -1.7, "crisis": -3.1, "fear": -2.2,
    "fears": -1.8, "fail": -2.5, "failed": -2.3, "war": -2.9, "death": -2.9, "negative": -2.7,
    "risk": -1.1, "attack": -2.1, "threat": -2.4, "sad": -2.1, "angry": -2.3, "problem": -1.7,
}
