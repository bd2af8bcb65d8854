"""Text expressions. Every pattern of the library is written here and nowhere else.

Patterns spell out Unicode classes: in Java ``\\w`` and ``\\d`` are ASCII-only, and ``(?U)\\w``
takes in combining marks. ``(?d)`` makes ``.`` stop at line feed only.
"""

from __future__ import annotations

import html.entities
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns.
WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"
TOKEN = WORD + "{2,15}"
TERM = WORD + "{2,}"
DIGITS = r"\p{Nd}+"
SPACE = r"[\s\x1c-\x1f]"
NON_SPACE = r"[^\s\x1c-\x1f]"

DOI_PREFIX = f"(?dU)doi:.*?{SPACE}"
ANGLED = "(?d)<.*?>"
ENTITY = "(?d)&.*?;"
URL = f"(?U)http{NON_SPACE}+"
SINGLE_MARKS = r"[\p{Nd}_.\-\[\]|]+"

HIDDEN_BLOCK = (
    r"(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
    r"|<template\b.*?(?:</template\s*>|\z)|<!--.*?(?:-->|\z)"
)
TAG = r"(?s)</?[A-Za-z][^>]*>|<[!?][^>]*>"

NAMED_ENTITY = r"^([A-Za-z][A-Za-z0-9]*;)"
DECIMAL_ENTITY = r"^#0*([0-9]{1,7});"
HEX_ENTITY = r"^#[xX]0*([0-9A-Fa-f]{1,6});"
HIGHEST_CODE_POINT = 0x10FFFF
# Names that count without a semicolon too, the longest first.
OPEN_ENTITY = "^(" + "|".join(
    sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
) + ")"


@cache
def named_entities(quoted: Callable[[str], str]) -> str:
    """Keys and values of the standard library's table of HTML 5 names, as SQL literals."""
    pairs = sorted(html.entities.html5.items())
    return ", ".join(f"{quoted(name)}, {quoted(value)}" for name, value in pairs)


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@cache
def _names_by_letter() -> str:
    """A literal map per first letter: a map is searched from its beginning, so short ones are faster."""
    letters: dict[str, list[str]] = {}
    for name, value in sorted(html.entities.html5.items()):
        letters.setdefault(name[0], []).append(f"{literal(name)}, {literal(value)}")
    return ", ".join(f"{literal(letter)}, map({', '.join(pairs)})" for letter, pairs in letters.items())


def _named(name: Column) -> Column:
    # Literal maps, written as SQL text, which parses faster than it crosses py4j.
    of_letter = F.try_element_at(F.expr(f"map({_names_by_letter()})"), F.substring(name, 1, 1))
    return F.try_element_at(of_letter, name)


def _character(code_point: Column) -> Column:
    usable = code_point.between(1, 0xD7FF) | code_point.between(0xE000, HIGHEST_CODE_POINT)
    encoded = F.unhex(F.lpad(F.hex(code_point), 8, "0"))
    return F.when(usable, F.decode(encoded, "UTF-32"))


def _decode_entity(part: Column) -> Column:
    """``part`` is what follows an ampersand; an unknown entity keeps its ampersand."""
    decimal = F.regexp_extract(part, DECIMAL_ENTITY, 1)
    hexadecimal = F.regexp_extract(part, HEX_ENTITY, 1)
    named, open_ = F.regexp_extract(part, NAMED_ENTITY, 1), F.regexp_extract(part, OPEN_ENTITY, 1)
    character = F.coalesce(
        _named(F.when(named != "", named)),
        _character(F.when(decimal != "", decimal.cast("long"))),
        _character(F.when(hexadecimal != "", F.conv(hexadecimal, 16, 10).cast("long"))),
    )
    rest = F.substring(part, F.instr(part, ";") + 1, F.length(part))
    after = F.concat(_named(F.when(open_ != "", open_)), F.substring(part, F.length(open_) + 1, F.length(part)))
    return F.coalesce(F.concat(character, rest), after, F.concat(F.lit("&"), part))


def strip_html(text: Column) -> Column:
    """Visible text of a markup fragment; text without markup passes through untouched."""
    untagged = F.regexp_replace(F.regexp_replace(text, HIDDEN_BLOCK, ""), TAG, "")
    visible = F.when(text.contains("<"), untagged).otherwise(text)
    parts = F.split(visible, "&", -1)
    decoded = F.array_join(
        F.transform(parts, lambda part, i: F.when(i == 0, part).otherwise(_decode_entity(part))),
        "",
    )
    return F.when(text.contains("<") | text.contains("&"), decoded).otherwise(text)


def _maybe_marked_up(text: Column) -> Column:
    """Whether a DOI prefix, tag, entity or URL may begin in a text; none begins elsewhere."""
    return text.contains("doi:") | text.contains("<") | text.contains("&") | text.contains("http")


def clean_reference(text: Column) -> Column:
    """Drop DOI prefixes, tags, entities and URLs, then digits and the marks ``_ . - [ | ]``.

    The marks are single characters, so one class removes them all in one pass. The text is bound
    to a variable, so that asking what it holds does not compute it anew.
    """

    return F.get(F.transform(F.array(text), clean_column), F.lit(0))


def clean_column(bound: Column) -> Column:
    """``clean_reference`` of a text that costs nothing to read again, such as a column."""
    whole = bound
    for pattern in (DOI_PREFIX, ANGLED, ENTITY, URL, SINGLE_MARKS):
        whole = F.regexp_replace(whole, pattern, "")
    return F.when(_maybe_marked_up(bound), whole).otherwise(F.regexp_replace(bound, SINGLE_MARKS, ""))


def clean_again(cleaned: Column) -> Column:
    """``clean_reference`` of a text that it gave: the marks are gone, a tag or URL may have formed."""
    return F.when(_maybe_marked_up(cleaned), clean_column(cleaned)).otherwise(cleaned)


def has_token(text: Column) -> Column:
    return text.rlike(TOKEN)


def tokenize(text: Column) -> Column:
    """Runs of 2 to 15 word characters; a longer run is cut greedily."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def terms(text: Column) -> Column:
    """Lower-cased runs of two or more word characters, as a bag-of-words vectoriser sees them."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def strip_digits(text: Column) -> Column:
    return F.regexp_replace(text, DIGITS, "")


def squash(text: Column) -> Column:
    """Remove spaces, so that a spaced name counts as one term."""
    return F.replace(text, F.lit(" "), F.lit(""))


def clean_title(title: Column) -> Column:
    """Drop entities, the literal ``SUB`` and tags from a title."""
    for pattern in (ENTITY, "SUB", ANGLED):
        title = F.regexp_replace(title, pattern, "")
    return title


def separated(values: Column) -> Column:
    return F.array_join(values, ", ")


def separated_tokens(vocabulary: Column) -> Column:
    return separated(F.sort_array(vocabulary))
