"""Identifiers of drawings and specification sections, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHEET_PATTERN = r"[A-Z]{1,3}[0-9]{0,2}[ ]*[-.][ ]*[0-9]{1,3}(?:[.][0-9]{1,2})?[A-Z]{0,3}"
SECTION_PATTERN = r"[0-9]{2}[ .-]+[0-9]{2}[ .-]+[0-9]{2}"


def normalize_sheet_id(raw: Column) -> Column:
    """Upper case without any white space."""
    return F.translate(F.upper(raw), " \t\r\n\f", "")


def normalize_section_id(raw: Column) -> Column:
    """``DD SS SS`` from the first six digits, padded with zeros on the right."""
    digits = F.rpad(F.regexp_replace(raw, F.lit("[^0-9]"), F.lit("")), 6, "0")
    return F.concat(F.substring(digits, 1, 2), F.lit(" "), F.substring(digits, 3, 2), F.lit(" "), F.substring(digits, 5, 2))


def normalize_section_id_strict(raw: Column) -> Column:
    """``DD SS SS`` if there are exactly six digits, else an empty string."""
    digits = F.regexp_replace(raw, F.lit("[^0-9]"), F.lit(""))
    return F.when(F.length(digits) == 6, normalize_section_id(raw)).otherwise("")


def sheet_prefix(normalized: Column) -> Column:
    """The leading letters of a sheet id; null for a section id, or without letters."""
    prefix = F.regexp_extract(F.upper(F.trim(normalized)), "^([A-Z]+)", 1)
    return F.when(F.trim(normalized).rlike("^[0-9]{2}[ ][0-9]{2}[ ][0-9]{2}"), None).when(prefix != "", prefix)


def section_format(code: Column) -> Column:
    """``modern-6digit``, ``legacy-5digit`` or ``invalid``."""
    code = F.trim(code)
    return F.when(code.rlike("^[0-9]{2}[ ][0-9]{2}[ ][0-9]{2}$"), "modern-6digit").when(code.rlike("^[0-9]{5}$"), "legacy-5digit").otherwise("invalid")


def section_codes(text: Column) -> Column:
    """All section codes of a text in their normal form, each once, in order of first appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({SECTION_PATTERN})"), F.lit(1)), normalize_section_id))


def footer_section_id(text: Column, division: str = "23") -> Column:
    """The first section code of one division, in any of four spellings."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(text, p.format(d=division), 0), F.lit("")) for p in ("{d} [0-9]{{2}} [0-9]{{2}}", "{d}-[0-9]{{2}}-[0-9]{{2}}", "{d}[.][0-9]{{2}}[.][0-9]{{2}}", "{d} - [0-9]{{2}} - [0-9]{{2}}")])
    return normalize_section_id(found)


def ids_in_text(text: Column) -> Column:
    """Sheet ids, then section ids, of a text, normalized and each once."""
    sheets = F.transform(F.regexp_extract_all(text, F.lit(f"({SHEET_PATTERN})"), F.lit(1)), normalize_sheet_id)
    sections = F.transform(F.regexp_extract_all(text, F.lit(f"({SECTION_PATTERN})"), F.lit(1)), normalize_section_id)
    return F.array_distinct(F.concat(sheets, sections))


def natural_key(text: Column, digits: int = 12) -> Column:
    """A string whose byte order is the natural order: numbers by value, before letters.

    A number becomes ``0`` and its value in ``digits`` places, letters become
    ``1`` and themselves; a text that ends first comes first.  Numbers of more
    digits keep their order only among themselves.
    """
    numbers = F.regexp_replace(text, F.lit("([0-9]+)"), F.lit("\u00010" + "0" * digits + "$1\u0001"))
    padded = F.regexp_replace(numbers, F.lit(f"\u00010[0-9]*([0-9]{{{digits}}})\u0001"), F.lit("\u00010$1\u0001"))
    return F.regexp_replace(padded, F.lit("\u0001([^0-9\u0001])"), F.lit("\u00011$1"))


def natural_key_sql(text: str, digits: int = 12) -> str:
    one = "chr(1)"
    numbers = f"regexp_replace({text}, '([0-9]+)', {one} || '0{'0' * digits}\\1' || {one}, 'g')"
    padded = f"regexp_replace({numbers}, {one} || '0[0-9]*([0-9]{{{digits}}})' || {one}, {one} || '0\\1' || {one}, 'g')"
    return f"regexp_replace({padded}, {one} || '([^0-9' || {one} || '])', {one} || '1\\1', 'g')"
