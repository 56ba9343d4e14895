"""Secret scans with corpus-wide ownership frequency (operator 8); DataFrame functions only.

Patterns find candidates in whole texts. Their hashes are counted over the
whole corpus by the different owners and repositories that have them: a value
that many owners have, or that one owner has in many repositories, is a copied example; one that belongs to a single owner, in few
repositories, and looks random is likely live. Places are counted in code points, the end excluded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.lookup import bind
from tidewire.session import cut_lineage

# The kinds in order, what is marked as match and value, and the least length of the value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
BASE = (
    ("assign", ASSIGN, "\x01$1\x02$2\x01", 8),
    ("access", r"AKIA[A-Z0-9]+", "\x01$0\x01", 16),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{32,}+", "\x01$0\x01", 32),
)
# Candidates beyond the base: long unbroken runs. They only count if they look random and have one owner.
EXTRA = ("owned", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}+", "\x01$0\x01", 20)
PLACEHOLDER = r"(?i)example|sample|dummy|change|placeholder|your|test|xxxx|0000|1234"
SPAN = "array<struct<start:int,no:int,end:int,kind:string,hash:bigint,random:boolean>>"
COUNTS = "array<struct<start:int,no:int,end:int,kind:string,owners:bigint,repositories:bigint>>"
WIDE_OWNERS = 3
WIDE_REPOSITORIES = 3


def _looks_random(value: Column) -> Column:
    """Letters and digits of both kinds, many different ones, and no word that marks an example."""
    different = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (different >= 10) & ~value.rlike(PLACEHOLDER)


def _spans(text: Column, no: int, kind: str, pattern: str, mark: str, least: int) -> Column:
    """All matches of one kind, leftmost first, those with a short value left out.

    The matches are set apart by a mark, which the text cannot hold since it was replaced before.
    """

    def places(parts: Column) -> Column:
        lengths = F.transform(parts, lambda p: F.char_length(F.replace(p, F.lit("\x02"), F.lit(""))))
        starts = F.aggregate(lengths, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
        return F.transform(F.sequence(F.lit(2), F.size(parts), F.lit(2)), lambda i: span(F.element_at(parts, i), F.element_at(starts, i), F.element_at(starts, i + 1)))

    def span(part: Column, start: Column, end: Column) -> Column:
        value = F.substring_index(part, "\x02", -1)
        return F.struct(
            start.alias("start"), F.lit(no).alias("no"), end.alias("end"), F.lit(kind).alias("kind"),
            F.xxhash64(value).alias("hash"), (F.char_length(value) >= least).alias("long"), _looks_random(value).alias("random"),
        )

    found = bind(F.split(F.regexp_replace(text, pattern, mark), "\x01"), lambda parts: F.when(F.size(parts) > 1, places(parts)))
    long = F.filter(F.coalesce(found, F.lit([]).cast("array<struct<start:int,no:int,end:int,kind:string,hash:bigint,long:boolean,random:boolean>>")), lambda s: s["long"])
    return F.transform(long, lambda s: s.dropFields("long")).cast(SPAN)


def candidates(docs: DataFrame, doc_id: str, text: str, owner: str, repository: Column | str) -> DataFrame:
    """(doc_id, row, owner, repository, base, extra): the spans of every whole text.

    ``row`` is equal for equal rows only. ``extra`` has no span that touches a base one.
    """
    whole = F.translate(F.coalesce(F.col(text), F.lit("")), "\x01\x02", "\x03\x03")
    kinds = [_spans(F.col("_text"), no, *rule) for no, rule in enumerate(BASE)]
    repo = F.col(repository) if isinstance(repository, str) else repository
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), row_key(doc_id, text), F.col(owner).alias("owner"), repo.alias("repository"), whole.alias("_text"),
    )
    rows = rows.withColumns({"base": F.array_sort(F.concat(*kinds)), "extra": _spans(F.col("_text"), len(BASE), *EXTRA)})
    apart = F.filter("extra", lambda e: e["random"] & ~F.exists("base", lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"])))
    return rows.withColumn("extra", apart).drop("_text")


def row_key(doc_id: str, text: str) -> Column:
    """Equal for equal (id, text): the id with a hash of both."""
    return F.struct(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.xxhash64(doc_id, text).alias("hash")).alias("row")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repositories): how many different ones have each candidate. A null owner is one owner."""
    hashes = F.transform(F.concat("base", "extra"), lambda s: s["hash"])
    who = [F.coalesce(c, F.lit("")).alias(c) for c in ("owner", "repository")]
    pairs = found.select(F.explode(hashes).alias("hash"), *who).distinct()
    return pairs.groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count("*").alias("repositories"))


def scan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: Column | str = "source",
    wide_owners: int = WIDE_OWNERS, wide_repositories: int = WIDE_REPOSITORIES,
) -> DataFrame:
    """(doc_id, row, base, added, copied, live, counts): the spans of every row of ``docs``.

    ``base`` has the spans of the fixed patterns, ``added`` the random-looking
    runs whose value only one owner has, in fewer than ``wide_repositories``. ``copied`` counts the spans of
    ``base`` whose value ``wide_owners`` owners or ``wide_repositories`` repositories or more have, ``live`` those of all that look random and
    are owner-specific. ``counts`` has, for each span of ``base`` and ``added``, how many owners and repositories have its value.
    Null texts count as empty; equal rows get equal results.
    """
    found = cut_lineage(candidates(docs, doc_id, text, owner, repository))
    some = found.filter((F.size("base") > 0) | (F.size("extra") > 0))
    known = ownership(some)
    each = some.select("row", F.explode(F.concat("base", "extra")).alias("span")).distinct()
    judged = each.withColumn("hash", F.col("span")["hash"]).join(known, "hash")
    is_base = F.col("span")["no"] < len(BASE)
    specific = (F.col("owners") == 1) & (F.col("repositories") < wide_repositories)
    wide = (F.col("owners") >= wide_owners) | (F.col("repositories") >= wide_repositories)
    added = F.collect_list(F.when(~is_base & specific, F.col("span")))
    count = F.struct(*[F.col("span")[c].alias(c) for c in ("start", "no", "end", "kind")], F.col("owners").cast("long").alias("owners"), F.col("repositories").cast("long").alias("repositories"))
    verdict = judged.groupBy("row").agg(
        F.array_sort(added).alias("added"), F.count_if(is_base & wide).alias("copied"), F.count_if(specific & F.col("span")["random"]).alias("live"),
        F.array_sort(F.collect_list(F.when(is_base | specific, count))).alias("counts"),
    )
    full = found.select("doc_id", "row", "base").join(verdict, "row", "left")
    zero = F.lit(0).cast("long")
    return full.select(
        "doc_id", "row", "base", F.coalesce("added", F.lit([]).cast(SPAN)).alias("added"),
        F.coalesce("copied", zero).alias("copied"), F.coalesce("live", zero).alias("live"),
        F.coalesce("counts", F.lit([]).cast(COUNTS)).alias("counts"),
    )


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(spans: DataFrame) -> DataFrame:
    """Digest columns of ``scan``; ``n_owners`` and ``n_repositories`` go with ``spans``, one number for each."""
    of = lambda no: F.size(F.filter("base", lambda s: s["no"] == no)).cast("long")
    return spans.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "added")).alias("spans"),
        F.col("live").alias("n_live"), F.col("copied").alias("n_copied"),
        F.transform("counts", lambda s: s["owners"]).alias("n_owners"), F.transform("counts", lambda s: s["repositories"]).alias("n_repositories"),
    )


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mask: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every span of ``scan`` replaced by ``mask``; rows, other columns and null texts stay."""
    spans = scan(docs, doc_id, text, **options)
    hit = spans.select("row", F.array_sort(F.concat("base", "added")).alias("spans")).filter(F.size("spans") > 0).dropDuplicates(["row"])
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out")).cast("struct<at:int,out:string>")
    inside = F.col("whole")[text]

    def step(a: Column, s: Column) -> Column:
        part = F.when(s["start"] + 1 >= a["at"], F.concat(a["out"], inside.substr(a["at"], s["start"] + 1 - a["at"]), F.lit(mask))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["end"] + 1).alias("at"), part.alias("out"))

    masked = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], inside.substr(a["at"], F.char_length(inside))))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("whole"), row_key(doc_id, text)).join(hit, "row", "left")
    changed = F.when(F.col("spans").isNull(), inside).otherwise(masked)
    return rows.select(*[(changed if c == text else F.col("whole")[c]).alias(c) for c in docs.columns])
