"""Text cleaning and field resolution as Spark expressions."""

from __future__ import annotations

import html
from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns each collection is cleaned with and the lengths kept.
CITATION_NUMBER_OR_EDIT = r"\[\d+\]|\[edit\]"
CITATION_LIST = r"\[[0-9,; ]+\]"
HTML_TAG = r"<[^>]+>"
URL = r"http\S+|www\S+"
MIN_CLEAN_CHARS = 100
ANSWER_SEPARATOR = "\n\n[ANSWER]\n\n"
COMMON_ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "#39": "'", "apos": "'", "nbsp": "\u00a0", "amp": "&"}
TEXT_FIELDS = ("chunk_text", "text", "preview", "content")

# Java's whitespace class leaves out the four ASCII separators that the cleaned text must not keep.
_BLANK_RUN = r"(?U)[\s\x1c-\x1f]+"
_BLANK_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
_URL_UNICODE = r"(?U)http[^\s\x1c-\x1f]+|www[^\s\x1c-\x1f]+"

_OTHER_ENTITY = f"&(?!(?:{'|'.join(COMMON_ENTITIES)});)[#A-Za-z]"


# What stands for an entity: a decimal or hexadecimal number, or a name, with or without its semicolon.
_ENTITY = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# Names that need no semicolon, the longest first, so that the longest of those that fit is found.
_BARE_NAMES = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))
_PAIR, _BETWEEN = "\x01", "\x02"
_NAMED = _BETWEEN.join(f"{name}{_PAIR}{value}" for name, value in html5.items())
# Numbers below 256 by the standard's rules: some stand for other characters, some for none.
_LOW = 256
_LOW_NUMBERS = [html.unescape(f"&#{n};") for n in range(_LOW)]
_REPLACEMENT = "\ufffd"


def _character(number: Column) -> Column:
    """The character of a code point from 256 on, by its UTF-16 code units."""
    units = F.when(number < 0x10000, F.lpad(F.hex(number), 4, "0")).otherwise(
        F.concat(F.hex(0xD800 + F.shiftright(number - 0x10000, 10)), F.hex(0xDC00 + (number - 0x10000).bitwiseAND(F.lit(0x3FF))))
    )
    return F.decode(F.unhex(units), "UTF-16BE")


def _numeric_entity(entity: Column) -> Column:
    digits = F.regexp_extract(entity, "[0-9a-fA-F]+", 0)
    significant = F.regexp_replace(digits, "^0+(?=.)", "")
    hexadecimal = F.substring(entity, 3, 1).isin("x", "X")
    # Nine digits are beyond the last code point in either base.
    number = F.when(F.length(significant) < 9, F.when(hexadecimal, F.conv(significant, 16, 10)).otherwise(significant).cast("bigint"))
    beyond = number.isNull() | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    nothing = number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    low = F.get(F.array(*[F.lit(c) for c in _LOW_NUMBERS]), number.cast("int"))
    return F.when(beyond, _REPLACEMENT).when(number < _LOW, low).when(nothing, "").otherwise(_character(number))


def _named_entity(entity: Column) -> Column:
    names = F.str_to_map(F.lit(_NAMED), F.lit(_BETWEEN), F.lit(_PAIR))
    bare = F.regexp_extract(entity, f"^&({_BARE_NAMES})", 1)
    shortened = F.concat(F.element_at(names, bare), F.substring(entity, F.length(bare) + 2, F.length(entity)))
    return F.coalesce(F.try_element_at(names, F.substring(entity, 2, F.length(entity))), F.when(bare != "", shortened), entity)


def unescape_html(text: Column) -> Column:
    """Decode named, decimal and hexadecimal entities, with or without a semicolon, as the HTML standard does.

    Where a text has only the common ones, they are replaced one after the other, the ampersand last so that nothing
    is decoded twice. Others are cut out, decoded one by one and put back between what stood around them.
    """
    common = text
    for entity, plain in COMMON_ENTITIES.items():
        common = F.replace(common, F.lit(f"&{entity};"), F.lit(plain))
    around = F.split(text, _ENTITY, -1)
    decoded = F.transform(
        F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0)),
        lambda e: F.when(F.substring(e, 2, 1) == "#", _numeric_entity(e)).otherwise(_named_entity(e)),
    )
    whole = F.array_join(F.flatten(F.zip_with(around, decoded, lambda a, d: F.array(a, F.coalesce(d, F.lit(""))))), "")
    return F.when(text.rlike(_OTHER_ENTITY), whole).when(text.contains("&"), common).otherwise(text)


def strip(text: Column) -> Column:
    """Without the Unicode whitespace at both ends."""
    return F.regexp_replace(text, _BLANK_ENDS, "")


def collapse_blanks(text: Column) -> Column:
    """Every run of Unicode whitespace becomes one space; none is left at the ends."""
    return F.trim(F.regexp_replace(text, _BLANK_RUN, " "))


def tokenise(text: Column) -> Column:
    """The whitespace-separated words; an empty text has none."""
    blank_free = collapse_blanks(text)
    return F.when(blank_free == "", F.array().cast("array<string>")).otherwise(F.split(blank_free, " "))


def _or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _where_bracketed(text: Column, replaced: Column) -> Column:
    """Search for marks only in texts that have a bracket at all."""
    return F.when(text.contains("["), replaced).otherwise(text)


def clean_encyclopedia(text: Column) -> Column:
    """Decode entities, drop ``[12]`` and ``[edit]`` marks, collapse whitespace."""
    decoded = unescape_html(_or_empty(text))
    marks_gone = _where_bracketed(decoded, F.regexp_replace(decoded, "(?U)" + CITATION_NUMBER_OR_EDIT, " "))
    return collapse_blanks(marks_gone)


def clean_abstract(text: Column) -> Column:
    """Decode entities, drop ``[1, 2; 3]`` citation lists, collapse whitespace."""
    decoded = unescape_html(_or_empty(text))
    return collapse_blanks(_where_bracketed(decoded, F.regexp_replace(decoded, CITATION_LIST, " ")))


def clean_html(text: Column) -> Column:
    """Decode entities, then drop tags, then addresses, then collapse whitespace.

    The order matters: a decoded ``&lt;b&gt;`` is a tag and goes away too.
    """
    tags_gone = F.regexp_replace(unescape_html(_or_empty(text)), HTML_TAG, " ")
    return collapse_blanks(F.regexp_replace(tags_gone, _URL_UNICODE, " "))


CLEANERS = {"encyclopedia": clean_encyclopedia, "abstract": clean_abstract, "html": clean_html}


def long_enough(clean_text: Column, more_than: int = MIN_CLEAN_CHARS) -> Column:
    """Strictly more than ``more_than`` code points."""
    return F.length(clean_text) > more_than


def first_non_empty(columns: Sequence[Column]) -> Column:
    """The first value that is neither null nor the empty string, else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def pick_text(available: Sequence[str], preference: Sequence[str] = TEXT_FIELDS) -> Column:
    """The preferred non-empty text among the columns that exist."""
    return first_non_empty([F.col(name) for name in preference if name in available])


def normalize_label(value: Column) -> Column:
    """Trimmed, lower-cased string; null stays null."""
    return F.lower(strip(value.cast("string")))


def resolve_source(available: Sequence[str]) -> Column:
    """The domain, else the source, else the empty string; trimmed and lower-cased."""
    return normalize_label(first_non_empty([F.col(n) for n in ("domain", "source") if n in available]))
