"""Text and placeholder functions as Column expressions (T), kept inside code generation.

White space is Python's: Java's `\\s` misses some of it, so the code points are named.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

PLACEHOLDER = r"\[\[/?T\d+\]\]"
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: Invisible characters that count as nothing (fixed values).
ZERO_WIDTH = r"[​‌‍⁠﻿]"

# Named entities that are text, not mark-up; amp comes last, so its result is not read again.
ENTITIES = {
    "apos": "'", "quot": '"', "lsquo": "\u2018", "rsquo": "\u2019", "ldquo": "\u201c", "rdquo": "\u201d",
    "sbquo": "\u201a", "bdquo": "\u201e", "laquo": "\u00ab", "raquo": "\u00bb", "prime": "\u2032", "Prime": "\u2033",
    "ndash": "\u2013", "mdash": "\u2014", "horbar": "\u2015", "hellip": "\u2026", "nbsp": "\u00a0", "ensp": "\u2002",
    "emsp": "\u2003", "thinsp": "\u2009", "hairsp": "\u200a", "numsp": "\u2007", "puncsp": "\u2008", "amp": "&",
}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def normalize_whitespace(c: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def placeholders(c: Column) -> Column:
    """The placeholder tokens of a text, in order."""
    return F.regexp_extract_all(c, F.lit(f"({PLACEHOLDER})"), 1)


def strip_placeholders(c: Column) -> Column:
    """Without tokens, runs of blanks and tabs as one blank."""
    return F.regexp_replace(F.regexp_replace(c, PLACEHOLDER, ""), r"[ \t]+", " ")


def is_trivially_empty(c: Column) -> Column:
    """Nothing but placeholders, zero-width characters and white space; true for null."""
    left = F.regexp_replace(F.regexp_replace(c, PLACEHOLDER, ""), ZERO_WIDTH, "")
    return F.coalesce(~left.rlike(f"[^\\s\\x1c-\\x1f\\x85\\p{{Z}}]"), F.lit(True))


def has_translatable_text(c: Column) -> Column:
    """As T03, but zero-width characters count as text."""
    return F.coalesce(F.regexp_replace(c, PLACEHOLDER, "").rlike(f"[^\\s\\x1c-\\x1f\\x85\\p{{Z}}]"), F.lit(False))


def compact_preview(c: Column, width: int = 60) -> Column:
    """One line of at most `width` characters; longer text ends with an ellipsis."""
    flat = normalize_whitespace(F.regexp_replace(c, PLACEHOLDER, ""))
    return F.when(F.length(flat) > width, F.concat(F.rtrim(F.substring(flat, 1, width - 1)), F.lit("…"))).otherwise(flat)


def expand_entities(c: Column) -> Column:
    """Named typographic entities as their characters, case-sensitive; lt, gt and amp stay."""
    return reduce(lambda col, kv: F.replace(col, F.lit(f"&{kv[0]};"), F.lit(kv[1])), ENTITIES.items(), c)


def restore_outer_whitespace(source: Column, target: Column) -> Column:
    """White space at the ends of the source goes to the target where that has none; empty texts stay."""
    lead, tail = F.regexp_extract(source, f"^({SPACE}*)", 1), F.regexp_extract(source, f"({SPACE}*)$", 1)
    blank = (source == "") | (target == "")
    head = F.when(target.rlike(f"^{SPACE}"), F.lit("")).otherwise(lead)
    end = F.when(target.rlike(f"{SPACE}$"), F.lit("")).otherwise(tail)
    return F.when(blank | source.isNull() | target.isNull(), target).otherwise(F.concat(head, target, end))


def placeholder_faults(text: Column, kinds: Column) -> Column:
    """Sorted faults of a text against the kinds (pair, void, entity) of its tokens; empty where sound."""
    found = placeholders(text)
    count = lambda tok: F.size(F.filter(found, lambda x: x == tok))
    index = F.sequence(F.lit(0), F.greatest(F.size(kinds) - 1, F.lit(0)))
    per = F.transform(
        F.filter(index, lambda k: k < F.size(kinds)),
        lambda k: F.when(
            F.element_at(kinds, (k + 1).cast("int")) == "pair",
            F.when(count(F.concat(F.lit("[[T"), k.cast("string"), F.lit("]]"))) != 1, F.concat(F.lit("opener "), k.cast("string")))
            .when(count(F.concat(F.lit("[[/T"), k.cast("string"), F.lit("]]"))) != 1, F.concat(F.lit("closer "), k.cast("string"))),
        ).otherwise(
            F.when(count(F.concat(F.lit("[[T"), k.cast("string"), F.lit("]]"))) != 1, F.concat(F.lit("single "), k.cast("string")))
            .when(count(F.concat(F.lit("[[/T"), k.cast("string"), F.lit("]]"))) != 0, F.concat(F.lit("stray closer "), k.cast("string"))),
        ),
    )
    numbers = F.transform(found, lambda x: F.regexp_extract(x, r"(\d+)", 1).cast("int"))
    beyond = F.transform(F.filter(F.array_distinct(numbers), lambda n: n >= F.size(kinds)), lambda n: F.concat(F.lit("range "), n.cast("string")))
    return F.array_sort(F.concat(F.filter(per, lambda x: x.isNotNull()), beyond))


def short_error(c: Column, width: int = 240) -> Column:
    """Cut with an ellipsis beyond `width` characters."""
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("…"))).otherwise(c)


def short_description(c: Column, width: int = 320, slack: int = 80) -> Column:
    """A description cut at the last full stop within `slack` of `width`, else at `width` with an ellipsis."""
    flat = normalize_whitespace(c)
    window = F.substring(flat, 1, width + slack)
    stop = F.length(window) - F.locate(".", F.reverse(window)) + 1
    whole = F.when((F.locate(".", window) > 0) & (stop >= width - slack), F.substring(window, 1, stop)).otherwise(F.concat(F.rtrim(F.substring(flat, 1, width)), F.lit("…")))
    return F.when(F.length(flat) <= width, flat).otherwise(whole)


def word_count(c: Column) -> Column:
    """Tokens between white space that hold a letter or digit; null where there are none."""
    n = F.size(F.filter(F.split(F.coalesce(c, F.lit("")), f"{SPACE}+"), lambda x: x.rlike(r"[\p{L}\p{N}]")))
    return F.when(n > 0, n)


def token_estimate(c: Column, least: int = 1) -> Column:
    """Characters div 4, at least `least` (0 for empty text in the other counter)."""
    size = F.coalesce(F.length(c), F.lit(0))
    return F.when(size == 0, F.lit(least)).otherwise(F.greatest(F.lit(1), F.floor(size / 4)).cast("int"))


def slug(c: Column) -> Column:
    """Q06: lower case, letters and digits kept, runs of blanks, dashes and underscores as one dash."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(c), r"[\s_-]+", "-"), r"[^\p{L}\p{N}-]", "")
    return F.regexp_replace(F.regexp_replace(kept, "-+", "-"), "^-|-$", "")


# Target languages whose words never open with an apostrophe.
NO_LEADING_APOSTROPHE = "pt es de ru uk ja ko zh ar he tr pl cs sk hu ro bg hr sr sl fi et lv lt el th vi id ms hi fa nl sv no nb nn da is".split()


def strip_orphan_apostrophes(c: Column, lang: Column) -> Column:
    """Apostrophes at the start of words go, for languages that have none there."""
    primary = F.substring_index(F.lower(F.trim(lang)), "-", 1)
    cleaned = F.regexp_replace(c, f"(^|{SPACE})['‘’ʼ]+(?=\\p{{L}})", "$1")
    return F.when(primary.isin(NO_LEADING_APOSTROPHE), cleaned).otherwise(c)
