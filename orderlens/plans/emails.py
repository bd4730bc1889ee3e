"""Email fact: one row per message."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import COMPLAINT_KEYWORDS, PREVIEW_LENGTH, SPAM_KEYWORDS
from ..functions import ids, text, time
from ..operators.hotkeys import flag_repeats
from ..sources.schemas import column_type, conform


def email_rows(
    communications: DataFrame,
    internal_domain: str,
    spam_keywords: Sequence[str] = SPAM_KEYWORDS,
    complaint_keywords: Sequence[str] = COMPLAINT_KEYWORDS,
) -> DataFrame:
    """The fact without the duplicate flag, which no other table needs."""
    mails = conform(communications, "communications").withColumnsRenamed(
        {"from": "from_email", "to": "to_email", "cc": "cc_recipients"}
    )
    sent_at = time.parse_instant(F.col("timestamp"), column_type(mails, "timestamp"))
    searchable = text.joined_text(*map(F.col, ["subject", "body", "vendor", "from_company"]))
    mails = mails.withColumns({"timestamp": sent_at, "_searchable": F.lower(searchable)})
    return mails.withColumns(
        {
            "source_message_id": ids.clean_id(F.col("message_id")),
            "customer_id_clean": ids.clean_id(F.col("customer_id")),
            "linked_order_id": ids.order_reference(F.col("subject"), F.col("body")),
            "canonical_message_id": ids.hash_key(
                F.col("message_id"),
                ids.instant_text(F.col("timestamp")),
                F.col("from_email"),
                F.col("to_email"),
                F.col("subject"),
                prefix="email",
            ),
            "message_scope": text.message_scope(
                F.col("from_email"), F.col("to_email"), internal_domain
            ),
            "is_spam_like": text.has_keyword(F.col("_searchable"), spam_keywords),
            "is_complaint_like": text.has_keyword(F.col("_searchable"), complaint_keywords),
            "event_date": time.day_text(F.col("timestamp")),
            "body_preview": text.preview(text.or_empty(F.col("body")), PREVIEW_LENGTH),
        }
    ).drop("_searchable")


def email_fact(
    communications: DataFrame,
    internal_domain: str,
    spam_keywords: Sequence[str] = SPAM_KEYWORDS,
    complaint_keywords: Sequence[str] = COMPLAINT_KEYWORDS,
) -> DataFrame:
    rows = email_rows(communications, internal_domain, spam_keywords, complaint_keywords)
    keys = communications.select(ids.clean_id(F.col("message_id")).alias("source_message_id"))
    return flag_repeats(rows, keys, "source_message_id", "is_duplicate_source_id")
