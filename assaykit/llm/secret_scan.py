"""Secrets in whole texts, told apart by who owns them: a value seen with many
owners or repositories is a copied example, a value of few looks live.
DataFrame functions only.

Base kinds (always kept): assign, access, hex. Kinds added by the method:
github, slack, jwt, private_key; they are kept only where the corpus-wide
ownership counts call the value live.

Defined cases: a null text counts as empty; a null owner or repository counts
as one owner or repository of its own; rows that repeat are separate rows of
the same owner; an empty table gives an empty result; columns other than those
named are not read, so names cannot clash.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import find_spans, span_list, whole
from assaykit.session import materialize

# The patterns of the base kinds, written without backtracking.
KEYWORDS = ["password", "passwd", "secret", "token", "api_?key"]
_HEAD = rf"""(?i:{'|'.join(KEYWORDS)})["']?\x20*+[:=]\x20*+["']?"""
ASSIGN = _HEAD + "[A-Za-z0-9+/_.=-]++"
ACCESS = "AKIA[A-Z0-9]++"
HEX = "(?<![0-9a-f])[0-9a-f]{32,}+"
# The kinds added.
GITHUB = "(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}+"
SLACK = "(?<![A-Za-z0-9-])xox[abprs]-[A-Za-z0-9-]{10,}+"
JWT = r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
PRIVATE_KEY = "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"

KINDS = ["assign", "access", "hex", "github", "slack", "jwt", "private_key"]
BASE = KINDS[:3]

#: From so many distinct owners, or distinct repositories, a value is a copied example.
MAX_OWNERS, MAX_REPOS = 3, 5

_SPAN = "struct<start:bigint,order:int,end:bigint,kind:string,value:string>"


def _value(kind: str, s: Column) -> Column:
    return F.regexp_replace(s["value"], "^" + _HEAD, "") if kind == "assign" else s["value"]


def _long_enough(kind: str, value: Column) -> Column:
    return F.length(value) >= {"assign": 8, "access": 16, "hex": 32}.get(kind, 0)


def _kept(k: int, kind: str, found: Column) -> Column:
    spans = F.transform(found, lambda s: F.struct(
        s["start"], F.lit(k).alias("order"), s["end"], F.lit(kind).alias("kind"), _value(kind, s).alias("value")))
    spans = F.filter(spans, lambda s: _long_enough(kind, s["value"]))
    return F.transform(spans, lambda s: s.withField("value", F.sha2(s["value"], 256)).cast(_SPAN))


def candidates(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``spans``: an array of (start, order, end,
    kind, digest of the secret value), sorted by start, then kind."""
    df = docs.select(*[F.col(f"`{c}`") for c in keep], whole(F.col(f"`{text}`")).alias("_text"))
    df = df.withColumn("_low", F.lower("_text"))
    t, low = F.col("_text"), F.col("_low")
    has = lambda part: F.contains(t, F.lit(part))
    worded = F.greatest(*[F.contains(low, F.lit(p)) for p in ("password", "passwd", "secret", "token", "apikey", "api_key")])
    df = find_spans(df, "_text", {
        "_assign": (ASSIGN, worded & (F.contains(t, F.lit("=")) | F.contains(t, F.lit(":")))),
        "_access": (ACCESS, has("AKIA")),
        "_hex": (HEX, F.length(t) >= 32),
        "_github": (GITHUB, F.contains(t, F.lit("gh")) & F.contains(t, F.lit("_"))),
        "_slack": (SLACK, has("xox")),
        "_jwt": (JWT, has("eyJ")),
        "_private_key": (PRIVATE_KEY, has("PRIVATE KEY-----")),
    })
    out = [_kept(k, kind, F.col(f"_{kind}")) for k, kind in enumerate(KINDS)]
    return df.select(*[F.col(f"`{c}`") for c in keep], F.sort_array(F.concat(*out)).alias("spans"))


def ownership(found: DataFrame, owner: str = "owner", repo: str = "repo") -> DataFrame:
    """One row per value digest: distinct owners, distinct repositories and
    whether the value is a copied example. ``found`` has one row per span.

    Copies inside one repository are merged before the shuffle, so a value
    that fills a third of all rows arrives as one row per task and repository."""
    pairs = found.select("value", F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("o"), F.coalesce(F.col(repo).cast("string"), F.lit("")).alias("r")).distinct()
    return (pairs.groupBy("value").agg(F.countDistinct("o").alias("n_owners"), F.countDistinct("r").alias("n_repos"))
            .withColumn("example", (F.col("n_owners") >= MAX_OWNERS) | (F.col("n_repos") >= MAX_REPOS)))


def scan(docs: DataFrame, text: str = "text", owner: Column | None = None, repo: Column | None = None) -> DataFrame:
    """One row per document: doc_id, ``spans`` (array of start, order, end,
    kind, value, example), base spans and the added ones that look live, and
    ``n_example_added``, the added ones left out as copied examples.

    ``owner`` and ``repo`` say whose document it is; by default the column
    ``source`` is the owner and (source, lang) the repository."""
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", F.coalesce(F.col("source"), F.lit("")), F.coalesce(F.col("lang"), F.lit(""))) if repo is None else repo
    marked = docs.select("doc_id", F.col(f"`{text}`").alias("text"), owner.alias("owner"), repo.alias("repo"))
    # Written once: row numbers are fixed from here on, and a lost executor re-reads the small table, not the texts.
    base = materialize(candidates(marked, "text", ("doc_id", "owner", "repo")).withColumn("row", F.monotonically_increasing_id()), "secrets")
    each = base.where(F.size("spans") > 0).select("row", "owner", "repo", F.posexplode("spans").alias("i", "s")).select("row", "owner", "repo", "i", F.col("s.value").alias("value"))
    # Written, so that the join of a value that fills a third of all rows is split at run time.
    verdict = materialize(ownership(each), "owners")
    per_row = (each.join(verdict.select("value", "example"), "value")
               .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("i", "example"))).alias("said")))
    both = base.join(per_row, "row", "left")
    judged = F.transform(F.col("spans"), lambda s, i: s.withField("example", F.coalesce(F.get(F.col("said"), i)["example"], F.lit(False))))
    both = both.select("doc_id", judged.alias("all"))
    added_example = lambda s: ~s["kind"].isin(BASE) & s["example"]
    return both.select("doc_id", F.filter("all", lambda s: ~added_example(s)).alias("spans"), F.size(F.filter("all", added_example)).cast("long").alias("n_example_added"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts and digest of the base spans, all
    spans, and how many of them are copied examples or look live."""
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return scan(docs).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(span_list(F.filter(spans, lambda s: s["kind"].isin(BASE))), 256).alias("base_sha256"),
        span_list(spans).alias("spans"),
        F.size(F.filter(spans, lambda s: s["example"])).cast("long").alias("n_example"),
        F.size(F.filter(spans, lambda s: ~s["example"])).cast("long").alias("n_live"))
