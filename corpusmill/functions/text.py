"""Text expressions: normalisation, stripping, keys, digests and name-based UUIDs. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points that strip() of a Unicode string removes, beyond the White_Space property.
SEPARATORS = r"\x1c-\x1f"
BOM = "﻿"


def normalize_newlines(text: Column) -> Column:
    """CRLF and CR become LF."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def drop_bom(text: Column) -> Column:
    """Without one leading byte-order mark."""
    return F.when(text.startswith(BOM), F.substring(text, 2, 2147483647)).otherwise(text)


def normalize_text(data: Column) -> Column:
    """Strict UTF-8 text of a binary or string column: one BOM off, LF line ends; null where bytes are not UTF-8."""
    return normalize_newlines(drop_bom(F.try_validate_utf8(data.cast("string"))))


def strip(text: Column) -> Column:
    """White space of any script off both ends; texts without any there are not searched."""
    blank = rf"[\s{SEPARATORS}]"
    edges = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    trimmed = F.regexp_replace(F.regexp_replace(text, rf"(?U)\A{blank}+", ""), rf"(?U)(?<!{blank}){blank}+\z", "")
    return F.when(edges.rlike(rf"(?U){blank}"), trimmed).otherwise(text)


def is_blank(text: Column) -> Column:
    return ~text.rlike(rf"(?U)[^\s{SEPARATORS}]")


def paragraph_key(text: Column) -> Column:
    """Line breaks to a blank, runs of blanks and tabs to one, both ends stripped; all else is significant."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"\r\n|\r|\n", " "), r"[ \t]+", " "))


def digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, lowercase hex."""
    return F.sha2(text.cast("binary"), 256)


def namespace_bytes(namespace: str | Column) -> Column:
    """The 16 bytes of a UUID string, or of a column of them."""
    space = F.lit(namespace) if isinstance(namespace, str) else namespace
    return F.unhex(F.replace(space, F.lit("-"), F.lit("")))


def uuid_of_sha1(h: Column) -> Column:
    """Version 5 UUID of a SHA-1 in hex."""
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def uuid5(namespace: str | Column, name: Column) -> Column:
    """Name-based UUID, version 5. ``namespace``: a UUID string, or a column of them."""
    return uuid_of_sha1(F.sha1(F.concat(namespace_bytes(namespace), name.cast("binary"))))


def request_fingerprint(columns: dict[str, Column]) -> Column:
    """SHA-256 of compact JSON with sorted keys; nulls are part of it."""
    pairs = [columns[k].alias(k) for k in sorted(columns)]
    return F.sha2(F.to_json(F.struct(*pairs), {"ignoreNullFields": "false"}), 256)
