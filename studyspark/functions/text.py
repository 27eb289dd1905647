"""Column functions for text whose white space, case and patterns behave alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as text editors know it: also the ideographic and no-break blanks, which a plain trim leaves.
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def stripped(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, f"\\A{SPACE}+|{SPACE}+\\z", "")


def collapsed(c: Column) -> Column:
    """Stripped, and each run of white space as one blank."""
    return stripped(F.regexp_replace(c, f"{SPACE}+", " "))


def normalized(c: Column) -> Column:
    """Collapsed and in lower case."""
    return F.lower(collapsed(c))


def java(pattern: str, ignore_case: bool = False, multiline: bool = False) -> str:
    """A pattern whose ``.`` excludes only the line feed, whose ``\\s`` knows all white space, and whose case folding knows all letters."""
    return "(?d" + "iu" * ignore_case + "m" * multiline + ")" + pattern.replace(r"\s", SPACE)


def found_literals(text: Column, phrases: list[str]) -> Column:
    """The phrases that the text contains, in list order."""
    hits = [F.when(F.contains(text, F.lit(p)), F.lit(p)) for p in phrases]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def found_patterns(text: Column, patterns: list[str], ignore_case: bool = True, multiline: bool = False) -> Column:
    """The patterns that the text matches somewhere, in list order."""
    hits = [F.when(text.rlike(java(p, ignore_case, multiline)), F.lit(p)) for p in patterns]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def tagged(tag: str, found: Column) -> Column:
    return F.transform(found, lambda m: F.concat(F.lit(tag + ":"), m))


def sql_literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"
