"""Column expressions on single lines of a document: noise, headings, signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.functions.text import WS, collapsed, lowered

# A line of a table of contents, front-matter titles, and what register bit rows are made of.
CONTENTS_LINE = r"(\.\s?){4,}\s*[0-9]+\s*\z"
FRONT_TITLES = ("contents", "list of tables", "list of figures", "table of contents")
BIT_TOKEN = r"\A([0-9]{1,2}|r|w|rw|rs|rt_w|rc_w0|rc_w1|rc_r|t|-|res\.?|reset|value)\z"
# Headings in markdown and numbered headings, and chapters without content of their own.
MD_HEADING = r"\A(#{1,6})\s+(.*?)\s*#*\z"
NUMBERED = r"\A([0-9]{1,2}(?:\.[0-9]{1,2}){0,4}|[A-Z]\.[0-9]{1,2}(?:\.[0-9]{1,2})*|Appendix\s+[A-Z])\s+[A-Z][A-Za-z][^\n]{1,88}\z"
SKIPPED_CHAPTER = (
    r"(?i)\A(?:[0-9]+\s+)?(contents|table of contents|list of tables|list of figures|index|revision history|"
    r"document revision history|important (security )?notice)\b"
)
PAGE_NUMBER = r"\A(page\s*)?#(\s*(/|of)\s*#)?\z"


def noise(line: Column) -> Column:
    """Why a line carries no text of its own: ``contents``, ``front`` or ``bits``; else null."""
    parts = F.split(F.trim(line), f"{WS}+")
    ruled = F.filter(parts, lambda t: F.lower(t).rlike(BIT_TOKEN))
    bits = (F.size(parts) >= 6) & (F.size(ruled) >= 0.8 * F.size(parts))
    return F.when(line.rlike(CONTENTS_LINE), "contents").when(lowered(line).isin(*FRONT_TITLES), "front").when(bits, "bits")


def md_heading(line: Column) -> Column:
    """(level, title) of a markdown heading, else null."""
    level = F.length(F.regexp_extract(line, MD_HEADING, 1))
    title = F.trim(F.regexp_extract(line, MD_HEADING, 2))
    return F.when(line.rlike(MD_HEADING) & (title != ""), F.struct(level.alias("level"), title.alias("title")))


def numbered_heading(line: Column) -> Column:
    """(level, title) of a numbered heading: as many levels as its number has, one if it starts with a letter; else null."""
    number = F.regexp_extract(line, NUMBERED, 1)
    level = F.when(number.rlike("^[0-9]"), F.size(F.split(number, "[.]"))).otherwise(1)
    ok = (F.length(line) <= 90) & ~line.rlike(r"[.,;]\z") & line.rlike(NUMBERED)
    return F.when(ok, F.struct(level.alias("level"), line.alias("title")))


def signature(line: Column, short: int = 40) -> Column:
    """What running headers share: collapsed, lower case, and digits alike in a line of at most ``short`` characters."""
    low = collapsed(lowered(line))
    return F.when(F.length(low) <= short, F.regexp_replace(low, "[0-9]+", "#")).otherwise(low)


def dehyphenated(text: Column) -> Column:
    """Lines joined again where a word was broken: a hyphen at a line's end before a small letter goes."""
    return F.regexp_replace(text, r"-\n(?=\p{Ll})", "")


def sentences(text: Column) -> Column:
    """Parts after each full stop, question or exclamation mark, semicolon or colon that white space follows."""
    return F.split(text, r"(?<=[.!?;:])\s+")
