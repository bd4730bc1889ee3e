"""Personal data in texts, with column functions only.

A regular expression per kind proposes spans, a validator confirms them (Luhn for cards,
mod-97 for bank accounts, ranges for the rest), and context words shortly before a span
(in the last CONTEXT_CHARS code points since the span of its kind before it, or whatever stood
there for a kind that needs context to count) raise its score. Base kinds count when their rule holds, whatever the score; the added
kinds count from THRESHOLD on.

Proposals never overlap within a kind and are not retried when their check fails. The
patterns are possessive and anchored at the beginning of a run of their characters, which
finds the same spans as the plain patterns but takes linear time and no deep recursion on
very long texts.

Defined cases: null text counts as empty and has no spans; rows that repeat a doc_id are
scanned each for itself; a null doc_id is passed on; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.5
CONTEXT_CHARS = 40
_CHUNK = 64
# A span that needs context has 11 characters or more.
_EARLIER = CONTEXT_CHARS // 11 + 1


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    confirmed: Callable[[Column], Column]
    score: float
    context: str
    raised: float
    base: bool


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _small_parts(text: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(text, "[.]"), small)


def _luhn(text: Column) -> Column:
    return _let(_digits(text), lambda d: F.length(d).between(14, 19) & F.call_function("luhn_check", d))


def _mod_97(text: Column) -> Column:
    """The account's check: letters as 10 to 35, the first four characters last."""
    def value(c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, code - 55).otherwise(code - 48).cast("int")

    def add(rest: Column, c: Column) -> Column:
        return _let(value(c), lambda v: (rest * F.when(v > 9, 100).otherwise(10) + v) % 97)

    bare = F.replace(text, F.lit(" "), F.lit(""))
    turned = _let(bare, lambda b: F.concat(F.substring(b, 5, 64), F.substring(b, 1, 4)))
    return F.aggregate(F.split(turned, ""), F.lit(0), add) == 1


def _issued(text: Column) -> Column:
    area = F.substring(text, 1, 3)
    never = area.isin("000", "666") | (F.substring(text, 1, 1) == "9")
    return ~never & (F.substring(text, 5, 2) != "00") & (F.substring(text, 8, 4) != "0000")


# Length of an account number by country, from the public registry.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV",
    22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST",
    26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA",
    30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
# The country's length where it ends there, else the longest run.
_IBAN = "|".join(
    [rf"(?:{c})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, c in _IBAN_LENGTHS.items()]
    + [r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"]
)

KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda s: F.lit(True), 0.9, "mail|contact|write", 0.1, True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         _small_parts, 0.6, "\\bip\\b|host|server|address|login", 0.3, True),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++",
         _luhn, 0.8, "card|credit|visa|payment|karte|tarjeta|carte", 0.2, True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]",
         lambda s: F.length(_digits(s)).between(10, 15), 0.7, "phone|call|tel|mobile|fax", 0.2, True),
    Kind("iban", rf"(?<![A-Za-z0-9])(?:{_IBAN})",
         _mod_97, 0.9, "iban|account|bank|konto|cuenta|compte", 0.1, False),
    Kind("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
         _issued, 0.3, "ssn|social security|tax id", 0.5, False),
)


def _starts(pieces: Column, matches: Column) -> Column:
    """Code point at which each match begins, from the pieces between the matches.

    Running sums go chunk by chunk: no array is copied once per match.
    """
    def running(steps: Column, begin: Column) -> Column:
        grown = F.aggregate(steps, F.array(begin), lambda sums, s: F.concat(sums, F.array(F.element_at(sums, -1) + s)))
        return _let(grown, lambda g: F.slice(g, 2, F.size(g) - 1))

    def chunked(steps: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(steps), F.lit(_CHUNK))
        return F.transform(firsts, lambda i: F.slice(steps, i, F.lit(_CHUNK)))

    def summed(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, b: a + b))
        ends = _let(totals, lambda t: running(t, F.lit(0)))
        parts = _let(ends, lambda e: F.zip_with(chunks, F.concat(F.array(F.lit(0)), F.slice(e, 1, F.size(e) - 1)), running))
        return F.flatten(parts)

    gaps = F.transform(pieces, F.length)
    own = F.concat(F.array(F.lit(0)), F.transform(matches, F.length))
    steps = F.zip_with(F.slice(gaps, 1, F.size(matches)), F.slice(own, 1, F.size(matches)), lambda a, b: a + b)
    return _let(steps, lambda s: _let(chunked(s), summed))


SPAN = "array<struct<start:int,number:int,end:int,ok:boolean,score:double>>"


def _spans(kind: Kind, number: int, pieces: Column, matches: Column) -> Column:
    """Confirmed spans as structs that sort by place, then kind."""
    def span(match: Column, at: Column) -> Column:
        raised = F.when(at["before"].rlike(kind.context), kind.score + kind.raised).otherwise(kind.score)
        return F.struct(
            at["start"].alias("start"), F.lit(number).alias("number"), (at["start"] + F.length(match)).alias("end"),
            kind.confirmed(match).alias("ok"), F.round(raised, 3).alias("score"),
        )

    def near(start: Column, piece: Column) -> Column:
        before = F.lower(F.substring(piece, -CONTEXT_CHARS, CONTEXT_CHARS))
        return F.struct(start.alias("start"), before.alias("before"))

    befores = F.slice(pieces, 1, F.size(matches))
    if not kind.base and kind.score < THRESHOLD:
        # With the matches and pieces before it; enough of them to fill the context.
        both = F.zip_with(F.concat(F.array(F.lit("")), matches), pieces, lambda m, p: F.concat(m, p))
        befores = _let(both, lambda b: F.transform(F.slice(b, 1, F.size(matches)), lambda _, i: F.array_join(
            F.slice(b, F.greatest(i - _EARLIER, F.lit(0)) + 1, F.least(i, F.lit(_EARLIER)) + 1), "")))
    places = F.zip_with(_starts(pieces, matches), befores, near)
    kept = F.filter(F.zip_with(matches, places, span), lambda s: s["ok"] & (F.lit(kind.base) | (s["score"] >= THRESHOLD)))
    return F.when(F.size(matches) > 0, kept).otherwise(F.array().cast(SPAN))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, text and `found`: spans (start, kind, end, score) by start, then kind."""
    text = F.coalesce("text", F.lit(""))
    frame = docs.select("doc_id", text.alias("text"))
    for kind in KINDS:
        # A text without any proposal is looked through once; only others are cut.
        matches = F.regexp_extract_all(F.col("text"), F.lit(kind.pattern), F.lit(0))
        frame = frame.withColumn(f"m_{kind.name}", matches)
    pieces = {k.name: F.when(F.size(f"m_{k.name}") > 0, F.split("text", k.pattern, -1)) for k in KINDS}
    frame = frame.withColumns({f"p_{k}": p for k, p in pieces.items()})
    spans = [_spans(k, n, F.col(f"p_{k.name}"), F.col(f"m_{k.name}")) for n, k in enumerate(KINDS)]
    frame = frame.select("doc_id", "text", F.array_sort(F.concat(*spans)).alias("sorted"))
    names = F.array(*(F.lit(k.name) for k in KINDS))
    out = F.transform("sorted", lambda s: F.struct(
        s["start"].alias("start"), names[s["number"]].alias("kind"), s["end"].alias("end"), s["score"].alias("score"),
        (s["number"] < sum(k.base for k in KINDS)).alias("base"),
    ))
    return frame.select("doc_id", "text", out.alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract."""
    def counted(name: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    def listed(spans: Column) -> Column:
        named = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(named, ",")

    return found.select(
        "doc_id", *(counted(k.name) for k in KINDS if k.base),
        F.sha2(listed(F.filter("found", lambda s: s["base"])), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
        F.transform("found", lambda s: s["score"]).alias("scores"),
    )


def masked(found: DataFrame) -> DataFrame:
    """doc_id and the text with every found span replaced by its kind in brackets."""
    def step(state: Column, s: Column) -> Column:
        ahead = s["start"] >= state["at"]
        gap = F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"])
        grown = F.concat(state["out"], gap, F.lit("["), s["kind"], F.lit("]"))
        return F.struct(
            F.when(ahead, grown).otherwise(state["out"]).alias("out"),
            F.greatest(state["at"], s["end"]).alias("at"),
        )

    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate("found", begin, step, lambda z: F.concat(z["out"], F.substring(F.col("text"), z["at"] + 1, F.length("text"))))
    return found.select("doc_id", done.alias("text"))
