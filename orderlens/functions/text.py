"""Text: searchable text, keyword flags, previews, labels and summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space and the four separators, spelled out: a class of ranges is matched
# several times faster than one under the flag for Unicode classes.
_SPACES = (
    r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
)


def or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def joined_text(*parts: Column) -> Column:
    """Parts with single spaces between them; a null part keeps its (empty) slot."""
    return F.concat_ws(" ", *[or_empty(part) for part in parts])


def has_keyword(lowered: Column, keywords: Sequence[str]) -> Column:
    """True when any keyword occurs in the text, also inside a word.

    The text comes in lower case (as a column of its own, so that it is computed
    once for all keywords). A keyword that holds another one is skipped.
    """
    needed = [
        word
        for word in dict.fromkeys(keywords)
        if not any(other != word and other in word for other in keywords)
    ]
    hits = [F.contains(lowered, F.lit(word)) for word in needed]
    return reduce(lambda left, right: left | right, hits, F.lit(False))


def count_keyword(text: Column, keyword: str) -> Column:
    """Non-overlapping occurrences of the keyword in the lower-cased text."""
    lowered = F.lower(or_empty(text))
    removed = F.replace(lowered, F.lit(keyword), F.lit(""))
    return ((F.length(lowered) - F.length(removed)) / F.lit(len(keyword))).cast("long")


def message_scope(sender: Column, receiver: Column, internal_domain: str) -> Column:
    """internal, external_inbound, external_outbound, or mixed (both ends outside)."""
    suffix = "@" + internal_domain
    from_inside = or_empty(sender).endswith(suffix)
    to_inside = or_empty(receiver).endswith(suffix)
    return (
        F.when(from_inside & to_inside, "internal")
        .when(to_inside, "external_inbound")
        .when(from_inside, "external_outbound")
        .otherwise("mixed")
    )


def collapsed(text: Column) -> Column:
    """White space collapsed to single spaces."""
    return F.regexp_replace(text, _SPACES, " ")


def preview(text: Column, length: int) -> Column:
    """White space collapsed to single spaces, then the leading characters.

    What the head of the text collapses to is the head of the collapsed text, so the whole
    text is only read where its head is not enough.
    """
    head = F.array(collapsed(F.substring(text, 1, 2 * length)))
    short = lambda shown: (F.length(shown) < length) & (F.length(text) > 2 * length)
    return F.transform(
        head,
        lambda shown: F.substring(F.when(short(shown), collapsed(text)).otherwise(shown), 1, length),
    )[0]


def document_summary(kind: Column, order_id: Column, customer_name: Column) -> Column:
    return F.concat(
        kind,
        F.lit(" for order "),
        F.coalesce(order_id, F.lit("unknown")),
        F.lit(", customer "),
        F.coalesce(customer_name, F.lit("unknown")),
    )


def id_or_na(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("<NA>"))


def true_false(flag: Column) -> Column:
    return F.initcap(flag.cast("string"))
