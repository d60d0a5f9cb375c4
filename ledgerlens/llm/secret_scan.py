"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by pattern in every text. A value that many owners or many
repositories carry is a copied example; one that only a few of both carry and
that mixes letters and digits looks live. So candidate hashes are aggregated over the whole corpus by
distinct repositories and owners, and the verdict is joined back to the
documents: a live-looking value adds a ``live`` span over it.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_on, renamed

# Kind, pattern (Java), group of the value, least length of the value, literal that any match holds.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),   # the runs of 16 and more among all runs
)
EXTRA = (
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("stripe", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}", 0, 24),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 20),
    ("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 20),
)
KINDS = tuple(k[0] for k in BASE + EXTRA) + ("live",)
#: Values of up to so many owners, and of up to so many repositories, can be live.
MAX_OWNERS = 2
MAX_REPOS = 4
_SPAN = "struct<s:int,k:int,e:int,vs:int,v:bigint,looks:boolean>"


def spans(text: Column, kind: int) -> Column:
    """Array of the kind's matches, leftmost first: start, kind, end, start of
    the value (code points, end exclusive), hash of the value, live-looking.

    The text between matches and the matches themselves are cut out by the same
    pattern; their lengths add up to the positions."""
    _, pattern, group, least = (BASE + EXTRA)[kind]
    parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"),
                         F.split(text, pattern, -1).alias("gap"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        looks = x["v"].rlike("[0-9]") & x["v"].rlike("[A-Za-z]")
        span = F.struct(start.alias("s"), F.lit(kind).alias("k"), end.alias("e"),
                        (end - F.length(x["v"])).alias("vs"), F.xxhash64(x["v"]).alias("v"), looks.alias("looks"))
        ok = F.coalesce(F.length(x["v"]) >= least, F.lit(False))
        return F.struct(F.coalesce(end, acc["at"]).alias("at"),
                        F.when(ok, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    none = F.array().cast(f"array<{_SPAN}>")
    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(none)


def _shown(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(
        ":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def ownership(found: DataFrame) -> DataFrame:
    """Per candidate value ``v``: distinct ``owners`` and ``repos`` (null counts as one)."""
    each = found.select("repo", "owner", F.explode("spans").alias("x")).select(F.col("x.v").alias("v"), "owner", "repo")
    per_owner = each.distinct().groupBy("v", "owner").agg(F.count("*").alias("n"))
    return per_owner.groupBy("v").agg(F.count("*").alias("owners"), F.sum("n").alias("repos"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
         repo_col: str = "doc_id", max_owners: int = MAX_OWNERS,
         max_repos: int = MAX_REPOS) -> DataFrame:
    """One row per input row: the id, ``n_assign``, ``n_access``, ``n_hex``,
    ``base_sha256``, ``spans``, ``n_live``, ``n_example``, and the largest numbers of
    owners and of repositories that any of its values has, ``most_owners``, ``most_repos``.

    A null text is taken as empty and finds nothing. Rows with equal id and text
    get equal rows back, as often as they came; such repeats count as one
    repository. Null owners are one owner, null repositories one repository. An
    empty table gives an empty result. Spans go by start, then kind as listed."""
    d = renamed(docs, id=id_col, text=text_col, owner=owner_col, repo=repo_col)
    text = F.coalesce("text", F.lit(""))
    found = cut(d.select("id", "owner", "repo", F.xxhash64(text).alias("h"), F.array_sort(
        F.concat(*[spans(text, k) for k in range(len(BASE + EXTRA))])).alias("spans")))
    owned = ownership(found)
    occurs = found.select("id", "h", F.explode("spans").alias("x")).select(
        "id", "h", F.col("x.v").alias("v"), F.col("x.looks").alias("looks")).distinct()
    few = (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)
    judged = occurs.join(owned, "v").withColumn("few", few).withColumn("live", F.col("looks") & F.col("few"))
    per_doc = judged.groupBy("id", "h").agg(
        F.collect_set(F.when(F.col("live"), F.col("v"))).alias("live"),
        F.count(F.when(~F.col("few"), 1)).alias("n_example"), F.max("owners").alias("owners"), F.max("repos").alias("repos"))
    out = join_on(found.drop("owner", "repo"), per_doc, ["id", "h"], "left")
    base = F.filter("spans", lambda x: x["k"] < len(BASE))
    live = F.array_distinct(F.transform(
        F.filter("spans", lambda x: F.coalesce(F.array_contains("live", x["v"]), F.lit(False))),
        lambda x: F.struct(x["vs"].alias("s"), F.lit(len(KINDS) - 1).alias("k"), x["e"].alias("e"))))
    every = F.array_sort(F.concat(F.transform("spans", lambda x: F.struct(
        x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))), live))
    count = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    return out.select(
        F.col("id").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_shown(base), 256).alias("base_sha256"), _shown(every).alias("spans"),
        F.size(live).cast("long").alias("n_live"),
        F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"),
        F.coalesce("owners", F.lit(0)).cast("long").alias("most_owners"),
        F.coalesce("repos", F.lit(0)).cast("long").alias("most_repos"))
