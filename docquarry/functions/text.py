"""Column expressions on text; all stay inside Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind, in the pattern language of Spark and of the checking SQL.
WS = "[\\s\\p{Z}\\x{0B}\\x{1C}-\\x{1F}\\x{85}]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Words of a question that are not looked for.
STOP_WORDS = (
    "a an and are as at be by can could do does for from how i if in into is it its of on or "
    "should that the their there these this to use used using was what when where which who "
    "why will with would you your me my we our about"
).split()
# Phrases by which an answer declines, English and Turkish.
DECLINES = (
    "don't have that information", "do not have that information", "not in the provided",
    "bilgiye sahip değilim", "bilgi bulunmamaktadır", "belgelerde yer almıyor", "dokümanlarda yer almıyor",
)
# Fixed value: names of peripherals of which there are several.
INSTANCE = "^gpio(?=[a-k]$)|^(tim|usart|uart|spi|i2c|i2s|dma|adc|can|dac|otg)(?=[0-9]+$)"


def tokens(text: Column) -> Column:
    """Lower-case ASCII words and identifiers; null gives null."""
    return F.regexp_extract_all(F.lower(F.translate(text, "İ", " ")), F.lit("([a-z0-9_]+)"), 1)


def identifiers(text: Column) -> Column:
    """Upper-case names with a digit before their only underscore, as the SQL of the older queries has them; see ``names``."""
    return F.regexp_extract_all(text, F.lit("([A-Z]+[0-9][A-Z0-9]*_[A-Z0-9]+)"), 1)


def names(text: Column) -> Column:
    """Whole words of a letter, letters and digits, and underscore parts, in either case; given in lower case."""
    word = "(?<![\\p{L}\\p{N}_])([A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+)(?![\\p{L}\\p{N}_])"
    return F.transform(F.regexp_extract_all(text, F.lit(word), 1), F.lower)


def name_variants(found: Column) -> Column:
    """Lower-case names and, of those of a numbered instance, the forms for any instance: usart2_sr gives usartx_sr and usart_sr."""

    def forms(name: Column) -> Column:
        base = F.regexp_extract(F.substring_index(name, "_", 1), INSTANCE, 0)
        rest = F.regexp_replace(name, "^[^_]*_", "")
        return F.when(base == "", F.array(name)).otherwise(F.array(name, F.concat(base, F.lit("x_"), rest), F.concat(base, F.lit("_"), rest)))

    return F.array_distinct(F.flatten(F.transform(found, forms)))


def squeezed(text: Column) -> Column:
    """Trimmed, each run of ASCII blanks one blank, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, "[ \\t\\r\\n]+", " ")))


def cited_ranks(answer: Column, max_rank: int | Column) -> Column:
    """The passage numbers an answer cites as ``[n]``, one or two digits, from 1 to ``max_rank``, in the order of first use."""
    numbers = F.transform(F.regexp_extract_all(answer, F.lit("\\[([0-9]{1,2})\\]"), 1), lambda x: x.cast("int"))
    return F.array_distinct(F.filter(numbers, lambda n: (n >= 1) & (n <= max_rank)))


def lowered(text: Column) -> Column:
    """Lower case, with a dotted capital I as a plain one."""
    return F.lower(F.translate(text, "\u0130", "i"))


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def collapsed(text: Column) -> Column:
    """Trimmed, each run of white space one blank."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def inlined(line: Column) -> Column:
    """A line with each run of blanks and tabs as one blank, trimmed of any white space."""
    return stripped(F.regexp_replace(line, "[ \\t]+", " "))


def packed(text: Column) -> Column:
    """Lower case without any white space."""
    return F.regexp_replace(lowered(text), f"{WS}+", "")


def contains_all(text: Column, groups: Column) -> Column:
    """Whether of every group of words one is held, whatever case and white space; no group is held by any text."""
    hay = packed(text)
    return F.forall(groups, lambda group: F.exists(group, lambda word: F.contains(hay, packed(word))))


def is_fallback(answer: Column) -> Column:
    """Whether an answer holds one of the phrases by which it declines."""
    low = lowered(answer)
    return F.exists(F.array(*[F.lit(h) for h in DECLINES]), lambda h: F.contains(low, h))


def markdown_cell(text: Column, most: int = 400) -> Column:
    """One line without cell borders, of at most ``most`` characters."""
    return F.substring(F.replace(collapsed(text), F.lit("|"), F.lit("\\|")), 1, most)


def word_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of any script; null gives none."""
    return F.regexp_extract_all(lowered(F.coalesce(text, F.lit(""))), F.lit("([\\p{L}\\p{N}]+)"), 1)


def match_terms(question: Column, most: int = 24) -> Column:
    """What to look for by keyword: array of (words, prefix).

    Names with underscores come first, as phrases; then each other word but
    stop words and single letters, once; words of four letters and more also
    match what they begin. At most ``most`` are kept.
    """
    ascii_low = F.translate(F.coalesce(question, F.lit("")), UPPER, UPPER.lower())
    phrases = F.transform(names(F.coalesce(question, F.lit(""))), lambda n: F.struct(F.split(n, "_").alias("words"), F.lit(False).alias("prefix")))
    single = F.array_distinct(F.regexp_extract_all(ascii_low, F.lit("([a-z0-9]+)"), 1))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    wanted = F.filter(single, lambda w: ~F.array_contains(stop, w) & ((F.length(w) > 1) | w.rlike("^[0-9]$")))
    words = F.transform(wanted, lambda w: F.struct(F.array(w).alias("words"), (F.length(w) >= 4).alias("prefix")))
    return F.slice(F.concat(phrases, words), 1, most)
