"""Text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python counts as white space.
SPACES = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

# The characters that html.escape replaces, ampersand first.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))


def normalize_cell(cell: Column) -> Column:
    """A cell without white space and ASCII hyphens; null stays null."""
    return F.regexp_replace(cell, f"[{SPACES}-]", "")


def strip(text: Column) -> Column:
    """White space of any kind taken off both ends."""
    return F.regexp_replace(text, f"^[{SPACES}]+|[{SPACES}]+$", "")


def html_escape(text: Column) -> Column:
    for plain, escaped in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def strip_captions(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<caption>.*?</caption>", "")


def normalize_grid(grid: Column) -> Column:
    return F.transform(grid, lambda row: F.transform(row, normalize_cell))


def data_url(content: Column, kind: str = "application/pdf") -> Column:
    """Bytes as a data URL, without the line breaks that base64() puts in."""
    return F.concat(F.lit(f"data:{kind};base64,"), F.regexp_replace(F.base64(content), r"[\r\n]", ""))


def output_path(path: Column, folder: str) -> Column:
    """Where a document's response goes: every `pdfs` becomes the folder, every `.pdf` becomes `.json`."""
    return F.replace(F.replace(path, F.lit("pdfs"), F.lit(folder)), F.lit(".pdf"), F.lit(".json"))


def retry_delay(retry_after_ms: Column, retry_after: Column, attempt: Column, most: int = 30) -> Column:
    """Seconds to wait: the service's own positive figure if it gives one, else 2^attempt, at most `most`."""
    ms, s = (c.try_cast("double") for c in (retry_after_ms, retry_after))
    said = [F.when(ms * 0.001 > 0, ms * 0.001), F.when(s > 0, s)]
    return F.coalesce(*said, F.least(F.pow(F.lit(2.0), attempt), F.lit(float(most))))


def slice_table(text: Column) -> Column:
    """From the first literal `<table>` to the end of the first literal `</table>`; null without an opener.
    Without a closer the end is 7 characters in, as if it had been found at -1."""
    begin, end = F.locate("<table>", text), F.locate("</table>", text)
    return F.when(begin > 0, F.substring(text, begin, F.greatest(end + 8 - begin, F.lit(0))))
