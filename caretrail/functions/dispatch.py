"""Values of an outgoing fax."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from caretrail.functions.defaults import col, null_if_empty


@dataclass(frozen=True)
class DispatchConfig:
    """What a deployment fixes: its host, its authorised fax number and the name it sends under."""

    host: str = "localhost:3000"
    sender_number: str = "19105550000"
    display_number: str = "19105550000"
    sender_name: str = "Referral Outreach"


# Cover sheet texts used where a campaign has none.
DEFAULT_SUBJECT = "Referral Information"
DEFAULT_MESSAGE = "Please see the attached referral information."
FORM_MESSAGE = "Please see the attached referral information. Thank you for your consideration."
DEFAULT_RECIPIENT = "Provider"


def document_url(c: Column | str, host: str) -> Column:
    """Absolute URL of a stored document path."""
    scheme = "http" if "localhost" in host else "https"
    return F.concat(F.lit(f"{scheme}://{host}"), col(c))


def short_id(c: Column | str) -> Column:
    """First ten characters, as the dispatch metadata carries them."""
    return F.substring(col(c), 1, 10)


def cover_sheet(
    from_name: Column | str, from_number: Column | str, company: Column | str, subject: Column | str,
    message: Column | str, include: Column | str, contact: Column | str, name: Column | str, cfg: DispatchConfig,
) -> Column:
    """Cover sheet of one fax, defaults filled in; plain defaults when the campaign has it switched off."""
    on = F.coalesce(col(include), F.lit(False))
    number = F.coalesce(null_if_empty(from_number), F.lit(cfg.display_number))
    info = F.concat_ws(" | ", null_if_empty(company), F.concat(F.lit("Fax: "), number))

    def either(value: Column | str, default: str) -> Column:
        return F.coalesce(F.when(on, null_if_empty(value)), F.lit(default))

    return F.struct(
        on.alias("includeCoversheet"),
        either(from_name, cfg.sender_name).alias("fromName"),
        F.when(on, number).alias("displayNumber"),
        F.when(on, info).otherwise("").alias("companyInfo"),
        either(F.coalesce(null_if_empty(contact), null_if_empty(name)), DEFAULT_RECIPIENT).alias("toName"),
        either(subject, DEFAULT_SUBJECT).alias("subject"),
        either(message, DEFAULT_MESSAGE).alias("message"),
    )


def cover_sheet_form(
    from_name: Column | str, from_number: Column | str, company: Column | str, subject: Column | str,
    message: Column | str, include: Column | str, cfg: DispatchConfig,
) -> Column:
    """What the cover sheet form starts with: other presets, and on unless switched off."""
    return F.struct(
        F.coalesce(null_if_empty(from_name), F.lit(cfg.sender_name)).alias("coverSheetFromName"),
        F.coalesce(col(from_number), F.lit("")).alias("coverSheetFromNumber"),
        F.coalesce(col(company), F.lit("")).alias("coverSheetCompanyInfo"),
        F.coalesce(null_if_empty(subject), F.lit(DEFAULT_SUBJECT)).alias("coverSheetSubject"),
        F.coalesce(null_if_empty(message), F.lit(FORM_MESSAGE)).alias("coverSheetMessage"),
        F.coalesce(col(include), F.lit(True)).alias("includeCoverSheet"),
    )
