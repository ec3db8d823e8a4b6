"""String functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[0-9+\-.Ee]+$"


def tokens(text: Column, separators: str = r"[ ,\t\r\n]+") -> Column:
    """Parts between separators, without empty ones."""
    return F.filter(F.split(text, separators), lambda t: t != "")


def quoted_tokens(text: Column) -> Column:
    """Parts between spaces; double quotes keep theirs together and go."""
    return F.transform(F.regexp_extract_all(text, F.lit(r'"[^"]*"|[^\s"]+'), F.lit(0)), lambda t: F.replace(t, F.lit('"'), F.lit("")))


def uncommented(text: Column, marks: str = "#;") -> Column:
    return F.regexp_replace(text, f"[{marks}].*$", "")


def quote_if_needed(text: Column) -> Column:
    return F.when(text.rlike(r"\s"), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text)


def join(parts: Column, separator: str) -> Column:
    return F.array_join(parts, separator)


def remove_all(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def trim(text: Column, chars: str = " \t") -> Column:
    return F.btrim(text, F.lit(chars))


def trim_leading(text: Column, chars: str = " \t") -> Column:
    return F.ltrim(text, F.lit(chars))


def trim_trailing(text: Column, chars: str = " \t") -> Column:
    return F.rtrim(text, F.lit(chars))


def lower(text: Column) -> Column:
    return F.lower(text)


def is_numeric(text: Column) -> Column:
    return text.rlike(NUMBER) & text.rlike(r"[0-9]")


def is_integer(text: Column) -> Column:
    return text.rlike(r"^[+-]?[0-9]+$")


def parse_bool(text: Column) -> Column:
    """True or False for the usual words, else null."""
    t = F.lower(trim(text))
    return F.when(t.isin("true", "1", "yes", "on"), True).when(t.isin("false", "0", "no", "off"), False)


def round_to(value: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", value)


def fixed_width(value: Column, width: int) -> Column:
    """Right-aligned, cut to the width."""
    return F.lpad(value.cast("string"), width, " ")


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def with_extension(path: Column, new: str) -> Column:
    return F.regexp_replace(path, r"(\.[^./]*)?$", new)
