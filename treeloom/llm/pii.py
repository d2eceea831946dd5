"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust a score. DataFrame functions only.

Base kinds, in this order: email, ip (parts at most 255), card (12 to 19 digits that pass Luhn), phone (9 to 15
digits after a plus). They stay whatever their score. Further kinds stay if their score reaches `least_score`: iban
(mod-97), social (a US social security number of a valid area and group), local_phone (no country code) and secret
(a long hexadecimal or prefixed access key). Each of those starts below or above the bound, and words of the kind
nearby raise the score, words before it that tell against it (an order number, a checksum, an example) lower it. Nearby is
up to `reach` characters on either side, as far as the next match of the same pattern.

Positions are code points, end exclusive. The patterns are written with possessive quantifiers and with \\G or a
look-behind at their start, so that a long run of letters or digits is scanned once; matches are the same.

Null text counts as empty and has no spans. A very long text, or one of very many spans, takes time in proportion
(places are running sums in blocks, text is cut by blocks). Every row is judged alone: repeated rows give repeated
results, an empty table an empty one, and other columns pass through `redact` unchanged, whatever their names. Spans
that start together are in order of their kind.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: cheap test that any text with a match passes
    needs: str
    base: bool
    score: float
    #: words near a span that make it likelier
    context: str
    #: words before a span that make it less likely
    against: str = r"example|sample|dummy|placeholder"


EMAIL_CHARS = "[A-Za-z0-9._%+-]"
KINDS = (
    Kind("email", rf"(?:\G|(?<!{EMAIL_CHARS})){EMAIL_CHARS}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True, 0.9, r"mail|contact|write to"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", True, 0.6, r"\bip\b|host|server|address"),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", "", True, 0.7, r"card|visa|credit|pay"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", True, 0.7, r"tel|phone|call|fax|mobile"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", False, 0.7, r"iban|bank|account|konto"),
    Kind("social", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", False, 0.5, r"\bssn\b|social security|taxpayer", r"order|invoice|part|isbn|version|example|sample"),
    Kind("local_phone", r"(?<![0-9+().-])(?<![0-9]\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])", "", False, 0.4, r"tel|phone|call|fax|mobile", r"order|invoice|part|isbn|version|example|sample"),
    Kind("secret", r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}+|(?:AKIA|ghp_|sk-|xox[abp]-)[A-Za-z0-9-]{16,64}+)(?![A-Za-z0-9])", "", False, 0.5, r"token|secret|passw|api.?key|access.?key|credential|bearer", r"commit|checksum|sha-?[0-9]|md5|digest|revision|example|sample"),
)
BASE = [k.name for k in KINDS if k.base]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    cells = F.split(F.reverse(digits), "")
    doubled = F.transform(cells, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number leaves 1 modulo 97 once its first four characters are moved to the end."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.split(F.concat(F.substring(plain, 5, 60), F.substring(plain, 1, 4)), "")

    def step(a: Column, c: Column) -> Column:
        letter = F.ascii(c) - F.lit(55)
        return F.when(c == "", a).when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + letter) % 97)

    return F.aggregate(turned, F.lit(0), step) == 1


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        n = F.length(_digits(value))
        return F.when(n.between(12, 19), luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return F.when(F.length(F.regexp_replace(value, " ", "")).between(15, 34), mod97(value)).otherwise(F.lit(False))
    if kind == "social":
        return ~value.rlike(r"^(?:000|666|9)|-00-|-0000$")
    if kind == "secret":  # letters and digits in it, and no single one throughout
        return value.rlike("[0-9]") & value.rlike("[a-zA-Z]") & ~value.rlike(r"(.)\1{7}")
    return F.lit(True)


BLOCK = 256
#: code points in which a text is cut; a piece of it is then found without a walk from its start
CHUNK = 4096


def running(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each of an array's integers, what step makes of start and all before it. In blocks, as appending copies an array."""
    kind = "struct<at:int,out:array<int>>"

    def over(xs: Column, first: Column) -> Column:
        return F.aggregate(xs, F.struct(first.alias("at"), F.array().cast("array<int>").alias("out")).cast(kind), lambda a, x: F.struct(step(a["at"], x).alias("at"), F.array_append(a["out"], a["at"]).alias("out")).cast(kind))

    def of(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda j: F.slice(xs, j * BLOCK + 1, BLOCK))
        return F.flatten(F.transform(F.array(blocks), whole))

    def whole(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, start, step))
        return F.flatten(F.flatten(F.transform(F.array(over(totals, start)["out"]), lambda first: F.transform(blocks, lambda b, j: over(b, F.get(first, j))["out"]))))

    return F.when(F.size(values) > 0, F.flatten(F.transform(F.array(values), of))).otherwise(F.array().cast("array<int>"))


def spans_of(text: Column, kind: Kind, reach: int, least_score: float) -> Column:
    """Array of (start, rank, kind, end, score) of one kind's confirmed spans."""

    def place(x: Column) -> Column:
        """Spans from what a pattern found (x.f) and the text between (x.b): x is bound once for each text."""
        steps = F.transform(x["f"], lambda v, i: F.length(F.get(x["b"], i)) + F.length(v))
        ends = F.arrays_zip(running(steps, F.lit(0), lambda a, n: a + n).alias("before"), x["f"].alias("value"))

        def span(m: Column, i: Column) -> Column:
            start = m["before"] + F.length(F.get(x["b"], i))
            ahead = F.lower(F.right(F.get(x["b"], i), F.lit(reach)))
            around = F.concat_ws(" ", ahead, F.lower(F.left(F.get(x["b"], i + 1), F.lit(reach))))
            score = F.lit(kind.score) + F.when(around.rlike(kind.context), F.lit(0.3)).otherwise(F.lit(0.0)) - F.when(ahead.rlike(kind.against), F.lit(0.3)).otherwise(F.lit(0.0))
            kept = F.when(valid(kind.name, m["value"]), F.least(F.round(score, 2), F.lit(1.0)))  # null: not confirmed
            return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind.name).alias("kind"), (start + F.length(m["value"])).alias("end"), kept.alias("score"))

        return F.transform(ends, span)

    cut = F.struct(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("f"), F.split(text, kind.pattern, -1).alias("b"))
    placed = F.flatten(F.transform(F.array(cut), place))
    out = F.filter(placed, lambda m: m["score"].isNotNull() if kind.base else m["score"] >= least_score)
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,score:double>>")
    maybe = F.contains(text, F.lit(kind.needs)) & text.rlike(kind.pattern) if kind.needs else text.rlike(kind.pattern)
    return F.when(maybe, out).otherwise(none)


def with_spans(docs: DataFrame, text_col: str = "text", out_col: str = "pii_spans", reach: int = 40, least_score: float = 0.6) -> DataFrame:
    """Adds the spans of all kinds, by start and then kind."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumn(out_col, F.array_sort(F.concat(*[spans_of(text, k, reach, least_score) for k in KINDS])))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, a digest of their spans, all spans, how many are of further kinds, and the best score."""
    rows = with_spans(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    base = F.filter("pii_spans", lambda s: s["kind"].isin(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return rows.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"), F.size(F.filter("pii_spans", lambda m: ~m["kind"].isin(BASE))).cast("long").alias("n_other"), F.array_max(F.transform("pii_spans", lambda m: m["score"])).alias("best_score"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Replaces each span by its kind's name in brackets; spans that overlap become one. Null text stays null."""
    name, whole = "__pii_spans", "__pii_text"
    rows, text = with_spans(docs.withColumn(whole, F.col(text_col).cast("string")), whole, name), F.col(whole)

    def piece(chunks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / CHUNK).cast("int")
        few = F.slice(chunks, first + 1, F.floor(end / CHUNK).cast("int") - first + 1)
        return F.substring(F.array_join(few, ""), start % CHUNK + 1, end - start)

    def build(x: Column) -> Column:
        before = running(F.transform(F.col(name), lambda m: m["end"]), F.lit(0), lambda a, e: F.greatest(a, e))
        rest = F.array_max(F.transform(F.col(name), lambda m: m["end"]))
        parts = F.transform(F.arrays_zip(before.alias("at"), F.col(name).alias("m")), lambda z: F.when(z["m"]["start"] < z["at"], F.lit("")).otherwise(F.concat(piece(x, z["at"], z["m"]["start"]), F.lit("["), F.upper(z["m"]["kind"]), F.lit("]"))))
        return F.concat(F.array_join(parts, ""), piece(x, rest, F.length(text)))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    built = F.element_at(F.transform(F.array(chunks), build), 1)
    return rows.withColumn(text_col, F.when(F.size(name) > 0, built).otherwise(text)).drop(name, whole)
