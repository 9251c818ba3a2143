"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Runs of a-z of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def blank_to_null(value: Column) -> Column:
    """Null for blank values and the words null and None."""
    trimmed = F.trim(value)
    return F.when(trimmed.isin("", "null", "None"), None).otherwise(trimmed)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \\t\\n]+", " "))


def clean_title(text: Column) -> Column:
    """Squeezed, without quotes around it and closing punctuation."""
    return F.regexp_replace(F.regexp_replace(squeeze(text), "^[\"']+|[\"']+$", ""), "[.:;,]+$", "")


def preview(text: Column, words: int = 15) -> Column:
    """The first words, with ` ...` if there are more."""
    parts = F.split(squeeze(text), " ")
    head = F.array_join(F.slice(parts, 1, words), " ")
    return F.when(F.size(parts) > words, F.concat(head, F.lit(" ..."))).otherwise(head)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def band(score: Column) -> Column:
    """Quality band of a similarity."""
    return F.when(score >= 0.72, "high").when(score >= 0.55, "moderate").otherwise("low")


def file_kind(head: Column) -> Column:
    """What the first bytes of a file say that it is."""
    low = F.lower(F.ltrim(F.substring(head, 1, 64)))
    return (
        F.when(low.startswith("%pdf"), "pdf")
        .when(low.startswith("{\\rtf"), "rtf")
        .when(low.startswith("<!doctype html") | low.startswith("<html"), "html")
        .when(low.startswith("<?xml"), "xml")
        .when(F.substring(head, 1, 2) == "PK", "zip")
        .otherwise("unknown")
    )
