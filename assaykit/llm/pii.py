"""Personal data in whole texts: patterns propose spans, checksums confirm
them, words nearby adjust the score. DataFrame functions only.

Base kinds (always kept): email, ip, card (Luhn), phone. Kinds added by the
method: iban (mod-97) and ssn, kept at a score of ``THRESHOLD`` or more.

Defined cases: a null text counts as empty; an empty text has no span; rows
that repeat get the same result each; an empty table gives an empty result;
other columns are carried only if named in ``keep``, so names cannot clash.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import find_spans, span_list, whole

# The patterns of the base kinds, written without backtracking.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# The kinds added.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE = KINDS[:4]

#: Score before context, of 100: how often the pattern alone, with its checksum, is personal data.
PRIOR = {"email": 80, "ip": 50, "card": 70, "phone": 60, "iban": 80, "ssn": 30}
#: Words within CONTEXT characters that raise a kind's score by RAISE or lower it by LOWER.
CONTEXT, RAISE, LOWER, THRESHOLD = 40, 25, 30, 50
NEAR = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": r"\bip\b|address|host|server|client|adresse",
    "card": "card|visa|credit|debit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security|insurance",
}
AGAINST = {
    "email": "noreply|no-reply|example",
    "ip": r"version|release|build|\bv\b",
    "card": "order|isbn|serial|invoice|tracking",
    "phone": "order|isbn|serial",
    "iban": "serial|sample",
    "ssn": "part|model|serial|order",
}


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        v = F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + worth(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number (no spaces) leaves 1 modulo 97, its first
    four characters moved to the end and letters read as 10 to 35."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.left(iban, F.lit(4)))

    def step(r: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (r * 100 + code - 55) % 97).otherwise((r * 10 + code - 48) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})$"))
    if kind == "iban":
        plain = F.replace(value, F.lit(" "), F.lit(""))
        return F.length(plain).between(15, 34) & mod97(plain)
    if kind == "ssn":
        return ~value.rlike("^(000|666|9)") & ~value.rlike("-00-|-0000$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)


def _score(kind: str, s: Column) -> Column:
    around = F.lower(F.concat(s["before"], F.lit(" "), s["after"]))
    raw = F.lit(PRIOR[kind]) + F.when(around.rlike(NEAR[kind]), RAISE).otherwise(0) - F.when(around.rlike(AGAINST[kind]), LOWER).otherwise(0)
    return F.least(F.lit(100), F.greatest(F.lit(0), raw))


def _cut(s: Column) -> Column:
    """The span of an account number up to the last space, or its end, to which
    its checksum holds, as upper-case words behind it match the pattern too;
    a null value if it holds nowhere."""
    parts = F.split(s["value"], " ")
    heads = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), " "))
    return F.transform(F.array(F.get(F.filter(heads, lambda v: _valid("iban", v)), F.lit(0))), lambda v: F.struct(
        s["start"], (s["start"] + F.length(v)).alias("end"), v.alias("value"), s["before"],
        F.left(F.concat(F.substring(s["value"], F.length(v) + 1, F.length(s["value"])), s["after"]), F.lit(CONTEXT)).alias("after")))[0]


def _kept(k: int, kind: str, found: Column) -> Column:
    if kind == "iban":
        good = F.filter(F.transform(found, _cut), lambda s: s["value"].isNotNull())
    else:
        good = F.filter(found, lambda s: _valid(kind, s["value"]))
    scored = F.transform(good, lambda s: F.struct(
        s["start"], F.lit(k).alias("order"), s["end"], F.lit(kind).alias("kind"), s["value"], _score(kind, s).alias("score")))
    return scored if kind in BASE else F.filter(scored, lambda s: s["score"] >= THRESHOLD)


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``spans``: an array of (start, order, end,
    kind, value, score) sorted by start, then kind."""
    df = docs.select(*[F.col(f"`{c}`") for c in keep], whole(F.col(f"`{text}`")).alias("_text"))
    df = df.withColumn("_digit", F.col("_text").rlike("[0-9]"))
    t, digit = F.col("_text"), F.col("_digit")
    df = find_spans(df, "_text", {
        "_email": (EMAIL, F.contains(t, F.lit("@"))),
        "_ip": (IP, digit & F.contains(t, F.lit("."))),
        "_card": (CARD, digit),
        "_phone": (PHONE, digit & F.contains(t, F.lit("+"))),
        "_iban": (IBAN, digit),
        "_ssn": (SSN, digit & F.contains(t, F.lit("-"))),
    }, CONTEXT)
    out = [_kept(k, kind, F.col(f"_{kind}")) for k, kind in enumerate(KINDS)]
    return df.select(*[F.col(f"`{c}`") for c in keep], F.sort_array(F.concat(*out)).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every span found replaced by ``[KIND]``; where spans
    overlap, the one that starts first is replaced. Null texts stay null."""
    found = scan(docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns])), text, ("_row",))
    body = whole(F.col(f"_row.`{text}`"))
    done = F.aggregate(
        F.col("spans"),
        F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] < a["pos"], a).otherwise(F.struct(
            s["end"].alias("pos"),
            F.concat(a["out"], F.substring(body, (a["pos"] + 1).cast("int"), (s["start"] - a["pos"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"))),
        lambda a: F.concat(a["out"], F.substring(body, (a["pos"] + 1).cast("int"), F.length(body))))
    new = F.when(F.col(f"_row.`{text}`").isNotNull(), done)
    return found.select(*[new.alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts and digest of the base spans, all
    spans, and their scores in the same order."""
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return scan(docs).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(span_list(F.filter(spans, lambda s: s["kind"].isin(BASE))), 256).alias("base_sha256"),
        span_list(spans).alias("spans"),
        F.array_join(F.transform(spans, lambda s: s["score"].cast("string")), ",").alias("scores"))

