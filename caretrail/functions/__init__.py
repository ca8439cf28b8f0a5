"""Column expressions. All are built-in expressions: no Python code runs per row."""

from caretrail.functions.dates import format_date, parse_instant, parse_local_date
from caretrail.functions.defaults import new_id, null_if_empty, null_if_zero, or_default, with_defaults
from caretrail.functions.dispatch import cover_sheet, document_url, short_id
from caretrail.functions.labels import campaign_type_label, map_event_status, map_final_status, type_caption
from caretrail.functions.payloads import event_response, provider_fax_id, send_response
from caretrail.functions.text import (
    address_line,
    base_name,
    clinic_address_lines,
    file_ext,
    fmt_coord,
    fmt_distance,
    import_note,
    locality_line,
    normalize_phone,
    parse_address,
    parse_int,
    url_path,
    website_url,
)

__all__ = [
    "address_line", "base_name", "campaign_type_label", "clinic_address_lines", "cover_sheet", "document_url",
    "event_response", "file_ext", "fmt_coord", "fmt_distance", "format_date", "import_note", "locality_line",
    "map_event_status", "map_final_status", "new_id", "normalize_phone", "null_if_empty", "null_if_zero",
    "or_default", "parse_address", "parse_instant", "parse_int", "parse_local_date", "provider_fax_id",
    "send_response", "short_id", "type_caption", "url_path", "website_url", "with_defaults",
]
