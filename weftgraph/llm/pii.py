"""Personal data found with DataFrame functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod 97 for account numbers, value ranges for
addresses), and words near a span adjust its score. Patterns are possessive and start where a run of their characters
starts, so the time is linear in the text however long its runs are, and matching needs no deep stack.

A span's place comes from the text between matches: ``split`` gives the gaps, ``regexp_extract_all`` the matches, and
running sums of their lengths the positions, all in code points. The same gaps hold the words around a match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, shield

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"


@dataclass(frozen=True)
class Kind:
    """A kind of span. hint: a text without this pattern has none; check: confirms a match; score: of a confirmed match,
    raised by ``lift`` where a word of ``near`` stands within ``AROUND`` characters before it, or after it in its
    clause, and lowered by as much where a word of ``against`` does; base kinds are kept at any score, others from ``KEEP``
    on."""

    name: str
    pattern: str
    hint: str
    check: str | None
    score: float
    near: str
    lift: float = 0.3
    base: bool = True
    against: str = "example|sample|dummy|order|invoice|serial|version|isbn|sku"


AROUND = 40
KEEP = 0.6
# \G: a run may also start where the last match ended, which a search from left to right would take
KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", "@", None, 0.9, "mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", "ip", 0.6, "ip|host|server|address|from"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", "card", 0.7, "card|visa|credit|pay|amex"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", "phone", 0.7, "phone|tel|call|fax|mobile"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", "iban", 0.9, "iban|account|bank", base=False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", "ssn", 0.4, "ssn|social|security", base=False),
    Kind("local_phone", r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])", "", None, 0.4, "phone|tel|call|fax|mobile", base=False),
)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number without blanks leaves 1 modulo 97, its first four characters moved to the end."""
    turned = F.concat(F.substring(account, 5, 1000), F.substring(account, 1, 4))

    def add(rest: Column, ch: Column) -> Column:
        code = F.ascii(ch)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda r, ch: F.when(ch == "", r).otherwise(add(r, ch))) == 1


def _confirmed(check: str | None, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if check == "ip":
        short = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(short, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if check == "card":
        return F.length(digits).between(13, 19) & luhn(F.substring(digits, 1, 19))
    if check == "phone":
        return F.length(digits).between(9, 15)
    if check == "iban":
        plain = F.regexp_replace(m, " ", "")
        return F.length(plain).between(15, 34) & mod97(F.substring(plain, 1, 34))
    if check == "ssn":
        return ~m.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


_SPAN = "array<struct<kind:string,start:long,end:long,score:double>>"


def _spans(kind: Kind, text: Column, gaps: Column, found: Column) -> Column:
    """Confirmed spans in the order of their places."""

    def step(acc: Column, i: Column) -> Column:
        m = F.get(found, i)
        start = acc["at"] + F.length(F.get(gaps, i))
        end = start + F.length(m)
        around = F.lower(F.concat(F.right(F.get(gaps, i), F.lit(AROUND)), F.lit(" "), F.regexp_extract(F.left(F.get(gaps, i + 1), F.lit(AROUND)), r"^[^.;!?\n]*", 0)))
        says = lambda words: F.when(around.rlike(rf"\b(?:{words})"), kind.lift).otherwise(0.0)
        score = F.round(F.greatest(F.least(F.lit(kind.score) + says(kind.near) - says(kind.against), F.lit(1.0)), F.lit(0.0)), 2)
        sure = _confirmed(kind.check, m) if kind.base else _confirmed(kind.check, m) & (score >= KEEP)
        one = F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), score.alias("score"))
        return F.struct(end.alias("at"), F.when(sure, F.concat(acc["spans"], F.array(one))).otherwise(acc["spans"]).alias("spans"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("spans"))
    return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), begin, step, lambda acc: acc["spans"])


def find(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with ``spans``: kind, start, end (code points, end exclusive) and score, by kind in the order of
    ``kinds``, then start.

    ``docs`` has text; a null or empty text has no spans. Spans of one kind don't overlap, those of two kinds may.
    Equal texts have equal spans. All other columns are kept, one that is named spans (in any case) with a 0 after its
    name; an empty table stays empty. Texts of any length are searched whole, in time that grows with their length.
    """
    names = docs.columns
    t = F.col("__t")
    at = docs.toDF(*[f"c{i}" for i in range(len(names))])
    df = at.withColumn("__t", F.coalesce(F.col(f"c{names.index('text')}").cast("string"), F.lit("")))
    df = df.withColumn("__digits", t.rlike("[0-9]"))
    for i, k in enumerate(kinds):
        may = (t.contains(k.hint) if k.hint else F.lit(True)) & (F.lit(True) if k.name == "email" else F.col("__digits"))
        df = df.withColumn(f"__m{i}", F.when(may, F.regexp_extract_all(t, F.lit(k.pattern), F.lit(0))))
    for i, k in enumerate(kinds):
        df = df.withColumn(f"__g{i}", F.when(F.size(f"__m{i}") > 0, F.split(t, k.pattern, -1)))
    spans = [F.when(F.size(f"__m{i}") > 0, _spans(k, t, F.col(f"__g{i}"), F.col(f"__m{i}"))).otherwise(F.array().cast(_SPAN)) for i, k in enumerate(kinds)]
    return df.select(*[F.col(f"c{i}").alias(n + "0" * (n.lower() == "spans")) for i, n in enumerate(names)], F.concat(*spans).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        put = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, put).otherwise(acc["out"]).alias("out"))

    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), s["end"].alias("end"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(by_place, begin, step, rest)).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; a null text stays null."""
    own, names = shield(docs, "text")
    found = find(own)
    out = found.select(*[F.when(F.col("text").isNotNull(), redacted(F.col("text"), F.col("spans"))).alias(c) if c == "text" else F.col(c) for c in names])
    return out.toDF(*docs.columns)


def digest(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans, comma-joined; of some kinds only if these are given."""
    kept = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text) its counts of base kinds, their digest, all spans as kind:start:end, and their
    scores in the same order."""
    found = find(pick(docs, "doc_id", "text"))
    base = tuple(k.name for k in KINDS if k.base)
    many = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[many(k) for k in base], F.sha2(digest(F.col("spans"), base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"))
