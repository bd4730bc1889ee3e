"""Identifiers: cleaning, hash keys, references found in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import NULL_MARKERS, ORDER_REFERENCE_DIGITS, WHITE_SPACE


def clean_id(value: Column) -> Column:
    """Strip white space; texts that stand for "missing" become null."""
    text = F.btrim(value.cast("string"), F.lit(WHITE_SPACE))
    return F.when(~text.isin(NULL_MARKERS), text)


def joinable(value: Column) -> Column:
    """A cleaned id with null as ''.

    Cleaned ids are never empty, so this is one-to-one and lets null keys meet
    null keys in plain equi-joins and groupings, on one shared partitioning.
    """
    return F.coalesce(value, F.lit(""))


def unjoinable(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def instant_text(value: Column) -> Column:
    """Canonical text of a timestamp inside hash keys: always with time of day."""
    return value.cast("string")


def hash_key(*parts: Column, prefix: str | None = None) -> Column:
    """First 16 hex digits of the SHA-1 over the ||-joined parts, null as ''."""
    texts = [F.coalesce(part.cast("string"), F.lit("")) for part in parts]
    if prefix is not None:
        texts.insert(0, F.lit(prefix))
    return F.substring(F.sha1(F.concat_ws("||", *texts)), 1, 16)


def order_reference(subject: Column, body: Column) -> Column:
    """First stand-alone run of ten digits in subject and body."""
    text = F.concat_ws(" ", F.coalesce(subject, F.lit("")), F.coalesce(body, F.lit("")))
    return order_reference_in(text)


def order_reference_in(text: Column) -> Column:
    """The bounds of a word are dear to test at every place, so only texts with a run of as many
    digits (of any script, as in the pattern) are searched for one that stands alone."""
    run = F.regexp_like(text, F.lit(rf"\p{{Nd}}{{{ORDER_REFERENCE_DIGITS}}}"))
    found = F.regexp_extract(text, rf"(?U)\b(\d{{{ORDER_REFERENCE_DIGITS}}})\b", 1)
    return F.nullif(F.when(run, found), F.lit(""))
