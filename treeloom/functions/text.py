"""Parsing and normalising scraped text, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"([0-9]+(?:\.[0-9]+)?)"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def strip_parentheses(text: Column) -> Column:
    return F.regexp_replace(text, r"\([^)]*\)", "")


def first_number(text: Column) -> Column:
    """First unsigned number, thousands separators removed."""
    return _found(F.regexp_replace(text, ",", ""), NUMBER).cast("double")


def percent(text: Column) -> Column:
    """First number of a percentage; its sign is dropped."""
    return first_number(text)


def billions(text: Column) -> Column:
    """An amount in billions, to three places: trillions times 1000, millions by 1000, else as it is."""
    plain = F.lower(strip_parentheses(text))
    n = first_number(plain)
    return F.round(F.when(F.contains(plain, F.lit("trillion")), n * 1000).when(F.contains(plain, F.lit("million")), n / 1000).otherwise(n), 3)


def digits_only(text: Column) -> Column:
    return F.nullif(F.regexp_replace(strip_parentheses(text), "[^0-9]", ""), F.lit("")).cast("bigint")


def world_rank(text: Column) -> Column:
    """The number of an ordinal in parentheses."""
    return _found(text, r"\(([0-9]+)(?:st|nd|rd|th)\)").cast("bigint")


def year_of(text: Column) -> Column:
    return _found(text, r"\b([0-9]{4})\b").cast("int")


def snake_case(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(text), r"[-\s/]+", "_"), r"[^0-9A-Za-z_]", ""))


def utc_offset(text: Column) -> Column:
    """UTC+HH:MM of the first part before a semicolon; a bare UTC is +00:00."""
    plain = F.translate(F.split_part(text, F.lit(";"), F.lit(1)), "−–", "--")
    sign, hour, minute = (_found(plain, r"UTC\s*([+-])\s*([0-9]{1,2})(?::([0-9]{2}))?", k) for k in (1, 2, 3))
    offset = F.concat(F.lit("UTC"), sign, F.lpad(hour, 2, "0"), F.lit(":"), F.coalesce(minute, F.lit("00")))
    return F.coalesce(offset, F.when(F.contains(plain, F.lit("UTC")), F.lit("UTC+00:00")))


def looks_like_date(text: Column) -> Column:
    return text.rlike(r"\b[0-9]{3,4}\b|\b(?:BC|AD|BCE|CE)\b")


def loose_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def collapse_spaces(text: Column) -> Column:
    """Special blanks, dashes and bullets made plain; runs of white space become one blank."""
    plain = F.translate(text, " –—•​", " --  ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def compare_text(text: Column) -> Column:
    return F.coalesce(F.lower(collapse_spaces(text)), F.lit(""))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, "[^0-9A-Za-z]+", "_"), "^_+|_+$", "")


def scalar_text(value: Column, kind: str) -> Column:
    """Text of a scalar: true and false in lower case, null as null."""
    text = F.when(value, F.lit("true")).otherwise(F.lit("false")) if kind == "boolean" else value.cast("string")
    return F.when(value.isNull(), F.lit("null")).otherwise(text)


def metric_text(value: Column) -> Column:
    """Short form with K, M or B; N/A for null."""
    size = F.abs(value)
    return (
        F.when(value.isNull(), F.lit("N/A"))
        .when(size >= 1e9, F.concat(F.format_string("%.1f", value / 1e9), F.lit("B")))
        .when(size >= 1e6, F.concat(F.format_string("%.1f", value / 1e6), F.lit("M")))
        .when(size >= 1e3, F.concat(F.format_string("%.1f", value / 1e3), F.lit("K")))
        .otherwise(F.format_string("%.1f", value))
    )
