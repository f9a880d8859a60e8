"""Conditions on uploads, pages, requests and tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvella.config import Settings
from corvella.functions.text import SPACE, strip

DEFAULTS = Settings()
# What counts as an address; white space of any script's kind ends it.
URL = rf"^https?://(?:[a-zA-Z0-9\-]+\.)+[a-zA-Z]{{2,}}(?::\p{{Nd}}+)?(?:/[^{SPACE[1:-1]}]*)?\n?\z"

# Media types under which browsers send tables.
TABLE_MEDIA = {
    ".csv": ["text/csv", "application/csv", "application/vnd.ms-excel", "text/plain", "application/octet-stream"],
    ".xlsx": ["application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/octet-stream"],
    ".xls": ["application/vnd.ms-excel", "application/octet-stream"],
}
ALLOWED_MEDIA = ["text/plain", "application/pdf", "text/markdown", "text/csv", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"]
LOADERS = {".txt": "text", ".pdf": "pdf", ".docx": "docx", ".md": "markdown", ".csv": "csv", ".xlsx": "excel", ".xls": "excel"}


def valid_url(url: Column) -> Column:
    return F.coalesce(url.rlike(URL), F.lit(False))


def suffix(name: Column) -> Column:
    """The lower-case suffix with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))


def loader(name: Column) -> Column:
    """Which loader reads a file; null for unknown suffixes."""
    return F.create_map(*[F.lit(x) for pair in LOADERS.items() for x in pair])[suffix(name)]


def asset_type(name: Column) -> Column:
    return F.when(suffix(name).isin(".csv", ".xlsx", ".xls"), F.lit("structured_data")).otherwise(F.lit("file"))


def upload_decision(name: Column, media: Column, size: Column, most: int = DEFAULTS.file_bytes, allowed: list[str] | None = None) -> Column:
    """size_exceeded, accepted or type_not_supported, decided in this order: size, allowed type, Markdown, tables by suffix."""
    end = suffix(name)
    table = F.lit(False)
    for s, kinds in TABLE_MEDIA.items():
        table = table | ((end == s) & media.isin(*kinds))
    markdown = (end == ".md") & media.isin("application/octet-stream", "text/plain")
    ok = media.isin(*(ALLOWED_MEDIA if allowed is None else allowed)) | markdown | table
    return F.when(size > most, F.lit("size_exceeded")).when(F.coalesce(ok, F.lit(False)), F.lit("accepted")).otherwise(F.lit("type_not_supported"))


def search_problem(text: Column, limit: Column, lang: Column) -> Column:
    """Why a search request is turned down; null for a good one.  The length counts before trimming."""
    told = F.lower(strip(lang))
    return (
        F.when(text.isNull() | (strip(text) == ""), F.lit("text_blank"))
        .when(F.length(text) > DEFAULTS.query_characters, F.lit("text_too_long"))
        .when(limit > DEFAULTS.search_most, F.lit("limit_too_high"))
        .when(lang.isNotNull() & ~told.isin("en", "ar"), F.lit("language_not_supported"))
    )


def scanned_page(chars: Column, tables: Column, largest_image: Column, area: Column) -> Column:
    """Few characters, no table, and an image over half the page."""
    return (chars < DEFAULTS.scanned_chars) & (tables == 0) & F.coalesce(F.try_divide(largest_image, area) >= DEFAULTS.scanned_image_share, F.lit(False))


def degenerate_header(header: Column) -> Column:
    """A header with blank or made-up names, or with many names too long for one."""
    vague = F.exists(header, lambda h: (strip(h) == "") | h.startswith("col_"))
    lengthy = F.size(F.filter(header, lambda h: F.length(h) > 60)) >= F.greatest(F.lit(1), F.floor(F.size(header) / 2))
    return vague | lengthy


def regular_rows(rows: Column, columns: Column) -> Column:
    return F.forall(rows, lambda r: F.size(r) == columns)


def dynamic_collection(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^collection_\d+_\d+(_|$)"), F.lit(False))


def retryable(status: Column, message: Column) -> Column:
    """Whether a failed call is worth another try."""
    told = F.lower(F.coalesce(message, F.lit(""))).rlike(r"rate limit|timeout|timed out|temporarily|unavailable|overloaded")
    return F.coalesce(status.isin(408, 409, 429) | status.between(500, 599), F.lit(False)) | told


def backoff_bound(attempt: Column, base: float = 1.0, most: float = 30.0) -> Column:
    """The longest pause before the next try, in seconds."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt))


def retry_after(header: Column, most: float = 30.0) -> Column:
    seconds = header.try_cast("double")
    return F.when(seconds >= 0, F.least(seconds, F.lit(most)))


def pause(attempt: Column, told: Column, share: Column, base: float = 1.0, most: float = 30.0) -> Column:
    """Seconds until the next try: what the service told, else a share (0 to 1) of the doubling bound; never more than ``most``."""
    return F.least(F.when(told >= 0, told).otherwise(share * base * F.pow(F.lit(2.0), attempt)), F.lit(most))


def tries_again(status: Column, message: Column, attempt: Column, most: int = DEFAULTS.vision_retries) -> Column:
    """Whether a call that failed at its ``attempt`` (from 0) is made again."""
    return retryable(status, message) & (attempt < most)


def given_or(value: Column, default: Column | float) -> Column:
    """A setting, or the default where it is null, zero or empty."""
    default = default if isinstance(default, Column) else F.lit(default)
    return F.when(value.isNull() | (value == F.lit(0)), default).otherwise(value)


def within_bytes(text: Column, most: int) -> Column:
    """Whether a text's UTF-8 form has at most so many bytes; null for a null one."""
    return F.octet_length(text) <= most
