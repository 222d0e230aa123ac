"""Recognising what a fetched payload is, from its first bytes, headers and URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidence import constants as K
from evidence.functions.text import is_json

_XLSX = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
_XLS = "application/vnd.ms-excel"


def _head(content: Column, size: int) -> Column:
    return F.substring(content, 1, size)


def _starts(content: Column, magic: bytes) -> Column:
    return _head(content, len(magic)) == F.lit(magic)


def _text_head(content: Column) -> Column:
    """First 512 bytes as Latin-1 text, so that every byte survives, left-trimmed of ASCII blanks."""
    return F.ltrim(F.decode(_head(content, 512), "ISO-8859-1"), F.lit(" \t\n\r\x0b\x0c"))


def _looks_html(text: Column) -> Column:
    low = F.lower(F.substring(text, 1, 256))
    return low.startswith("<!doctype html") | low.startswith("<html")


def tabular_format(url: Column, content_type: Column, content: Column) -> Column:
    """Struct ``(format, kind)``; a null format means the payload is no table."""
    u = F.lower(url)
    ct = F.lower(F.coalesce(content_type, F.lit("")))
    text = _text_head(content)
    utf8 = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    head_ok = F.is_valid_utf8(_head(content, 512).cast("string"))
    first_line = F.try_element_at(
        F.filter(
            F.split(_head(content, 512).cast("string"), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"),
            lambda x: F.btrim(x, F.lit(K.SPACE_CHARS)) != "",
        ),
        F.lit(1),
    )

    def found(fmt: str | None, kind) -> Column:
        return F.struct(
            F.lit(fmt).cast("string").alias("format"),
            (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"),
        )

    zipped = _starts(content, b"PK\x03\x04") | F.contains(ct, F.lit("spreadsheetml"))
    sheet_hint = (
        F.contains(u, F.lit(".xls"))
        | F.contains(ct, F.lit("excel"))
        | F.contains(ct, F.lit("spreadsheetml"))
    )
    return (
        F.when(_starts(content, b"%PDF-") | F.contains(ct, F.lit("application/pdf")), found(None, "application/pdf"))
        .when(zipped & sheet_hint, found("xlsx", _XLSX))
        .when(zipped, found(None, "application/zip (not spreadsheet)"))
        .when(_starts(content, b"\xd0\xcf\x11\xe0") | F.contains(ct, F.lit("ms-excel")), found("xls", _XLS))
        .when(_looks_html(text) | F.contains(ct, F.lit("text/html")), found(None, "text/html"))
        .when(F.contains(u, F.lit(".csv")) | F.contains(ct, F.lit("text/csv")), found("csv", "text/csv"))
        .when(
            F.contains(u, F.lit(".json")) | F.contains(ct, F.lit("application/json")),
            found("json", "application/json"),
        )
        .when(F.contains(u, F.lit(".xlsx")), found("xlsx", _XLSX))
        .when(F.contains(u, F.lit(".xls")), found("xls", _XLS))
        .when(
            (text.startswith("{") | text.startswith("[")) & is_json(utf8),
            found("json", "application/json (sniffed)"),
        )
        .when(head_ok & F.contains(first_line, F.lit(",")), found("csv", "text/csv (sniffed)"))
        .otherwise(found(None, F.when(ct == "", F.lit("unknown")).otherwise(ct)))
    )


def text_format(url: Column, content_type: Column, content: Column) -> Column:
    """pdf, html or txt: first bytes before header before URL."""
    u = F.lower(url)
    ct = F.lower(F.coalesce(content_type, F.lit("")))
    return (
        F.when(_starts(content, b"%PDF-"), F.lit("pdf"))
        .when(_looks_html(_text_head(content)), F.lit("html"))
        .when(F.contains(ct, F.lit("application/pdf")), F.lit("pdf"))
        .when(F.contains(ct, F.lit("text/html")), F.lit("html"))
        .when(F.contains(u, F.lit(".pdf")), F.lit("pdf"))
        .when(F.contains(u, F.lit(".html")) | F.contains(u, F.lit(".htm")), F.lit("html"))
        .otherwise(F.lit("txt"))
    )
