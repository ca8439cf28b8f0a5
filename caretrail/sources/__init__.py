"""Readers and writers."""

from caretrail.sources.documents import document_catalog
from caretrail.sources.output import write_json
from caretrail.sources.places import place_page_errors, read_geocodes, read_places
from caretrail.sources.requests import read_requests, rejected_lines
from caretrail.sources.tables import commit, lookup, read_entity, table_paths, write_snapshot

__all__ = [
    "commit", "document_catalog", "lookup", "place_page_errors", "read_entity", "read_places", "read_requests",
    "rejected_lines", "table_paths", "write_json", "write_snapshot",
]
