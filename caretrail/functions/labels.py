"""Captions and status mappings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from caretrail.functions.defaults import col

# Labels per campaign type, in the list view and in the form.
LIST_LABELS = {
    "EMAIL": "Email",
    "FAX": "Fax",
    "CALL": "Call",
    "EVENT": "Event",
    "DIRECT_MAIL": "Direct Mail",
    "SOCIAL_MEDIA": "Social Media",
}
FORM_LABELS = {
    "EMAIL": "Email Campaign",
    "FAX": "Fax Campaign",
    "CALL": "Call Campaign",
    "EVENT": "Event",
    "DIRECT_MAIL": "Direct Mail",
    "SOCIAL_MEDIA": "Social Media",
    "OTHER": "Other",
}
LABELS = {"list": LIST_LABELS, "form": FORM_LABELS}


def type_caption(c: Column | str) -> Column:
    """First character kept, the rest lower-cased: DIRECT_MAIL becomes Direct_mail."""
    text = col(c)
    return F.concat(F.substring(text, 1, 1), F.lower(F.substring(text, F.lit(2), F.length(text))))


def campaign_type_label(c: Column | str, style: str = "list") -> Column:
    """Label of a campaign type; an unknown code passes through."""
    code = col(c)
    cases = reduce(lambda acc, kv: acc.when(code == kv[0], kv[1]), LABELS[style].items(), F)
    return cases.otherwise(code)


def map_event_status(c: Column | str) -> Column:
    """Link status for a delivery event, whatever the case of its status text."""
    code = F.upper(col(c))
    return (
        F.when(code.isin("DELIVERED", "COMPLETED"), "SENT")
        .when(code.isin("FAILED", "ERROR"), "FAILED")
        .otherwise("PENDING")
    )


def map_final_status(c: Column | str) -> Column:
    """Link status for the provider's late answer; here the case matters."""
    code = col(c)
    return F.when(code == "delivered", "DELIVERED").when(code == "failed", "FAILED").otherwise("SENT")
