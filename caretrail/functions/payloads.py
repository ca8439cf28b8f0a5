"""JSON stored in ``campaign_link.response``, and ids found in provider answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caretrail.functions.defaults import col, null_if_empty

PROVIDER_ANSWER = "data STRUCT<sentFax: STRUCT<id: STRING>>, faxId STRING, id STRING"


def _json_or_empty(c: Column | str) -> Column:
    """JSON text as a nested value; missing or unreadable text becomes an empty object."""
    return F.coalesce(F.try_parse_json(col(c)), F.parse_json(F.lit("{}")))


def _millis(moment: Column) -> Column:
    """Milliseconds since 1970 of a stored (UTC) moment, whatever the session's zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), moment)


def sent_fax_id(fax_id: Column | str, data: Column | str, as_of: Column) -> Column:
    """The id of a sent fax: its own, else the one in the answer, else ``unknown-`` and the time."""
    return F.coalesce(
        null_if_empty(fax_id),
        null_if_empty(F.get_json_object(col(data), "$.id")),
        F.concat(F.lit("unknown-"), _millis(as_of).cast("string")),
    )


def send_response(
    success: Column | str, fax_id: Column | str, data: Column | str, error: Column | str, status: Column | str,
    as_of: Column, thrown: Column | str | None = None,
) -> Column:
    """What is stored after a send. A failure without status has no ``status`` key; a send that threw an error, instead of
    getting an answer, has the error alone."""
    details = _json_or_empty(data)
    sent = F.struct(
        sent_fax_id(fax_id, data, as_of).alias("faxId"),
        F.coalesce(null_if_empty(status), F.lit("sent")).alias("status"),
        details.alias("details"),
    )
    failed = F.struct(
        F.coalesce(null_if_empty(error), F.lit("Unknown error")).alias("error"),
        col(status).alias("status"),
        details.alias("data"),
    )
    text = F.when(col(success), F.to_json(sent)).otherwise(F.to_json(failed))
    if thrown is None:
        return text
    alone = F.struct(F.coalesce(null_if_empty(error), F.lit("Unknown error")).alias("error"))
    return F.when(col(thrown), F.to_json(alone)).otherwise(text)


def event_response(fax_id: Column | str, status: Column | str, updated_at: Column | str, error: Column | str) -> Column:
    """What is stored after a delivery event; ``error`` is written even when null."""
    # from the text of the moment: a date pattern would go through the session's zone and its clock changes
    text = col(updated_at).cast("timestamp_ntz").cast("string")
    millis = F.rpad(F.substring(text, 21, 3), 3, "0")
    stamp = F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8), F.lit("."), millis, F.lit("Z"))
    return F.to_json(
        F.struct(
            col(fax_id).alias("faxId"), col(status).alias("status"), stamp.alias("updatedAt"), col(error).alias("error")
        ),
        {"ignoreNullFields": "false"},
    )


def final_response(fax_id: Column | str, final_status: Column | str, details: Column | str) -> Column:
    """What is stored after the late status check."""
    return F.to_json(
        F.struct(
            col(fax_id).alias("faxId"),
            col(final_status).alias("finalStatus"),
            F.lit(True).alias("finalCheck"),
            _json_or_empty(details).alias("details"),
        )
    )


def provider_fax_id(answer: Column | str, tmp_id: Column | str) -> Column:
    """Id in a provider answer: data.sentFax.id, else faxId, else id, else the temporary id."""

    def found(parsed: Column) -> Column:
        ids = [parsed["data"]["sentFax"]["id"], parsed["faxId"], parsed["id"]]
        return F.coalesce(*[F.when(~v.isin("", "0"), v) for v in ids])

    # the lambda names the parsed answer, so the text is parsed once
    once = F.transform(F.array(F.from_json(col(answer), PROVIDER_ANSWER)), found)
    return F.coalesce(F.get(once, F.lit(0)), col(tmp_id))
