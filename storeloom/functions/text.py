"""Scalar functions on text as Column expressions; all stay in the JVM.

White space, word boundaries and string ends follow ECMAScript rather than Java:
``\\z`` ends a string, words are ASCII, and trimming takes Unicode spaces and the byte-order mark.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\t\n\x0B\f\r\p{Zs}  ﻿]"


def trim_spaces(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{_SPACE}+|{_SPACE}+\z", "")


def utf16_length(text: Column) -> Column:
    """Code units, as many scripting languages count a string's length."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def plain(value: str) -> str:
    """A pattern that matches ``value`` itself."""
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", value)


def unescape_markup(html: Column) -> Column:
    """``&amp;`` and ``\\/`` as they are meant."""
    return F.replace(F.replace(html, F.lit("&amp;"), F.lit("&")), F.lit("\\/"), F.lit("/"))


def artifact_url(raw: Column) -> Column:
    """A usable http(s) URL out of markup, else null."""
    url = trim_spaces(unescape_markup(raw))
    return F.when(url.rlike(r"(?i)\Ahttps?://"), url)


def without_fences(raw: Column) -> Column:
    """A model's answer without the code fence about it; any other answer as it is."""
    text = trim_spaces(raw)
    fenced = rf"(?s)\A```(?:json)?{_SPACE}*(.*?)\n?```\z"
    return F.when(text.rlike(fenced), F.regexp_extract(text, fenced, 1)).otherwise(raw)


def mime_type(content_type: Column) -> Column:
    kind = F.lower(content_type)
    return F.when(kind.contains("png"), "image/png").when(kind.contains("webp"), "image/webp").otherwise("image/jpeg")


def extension_of(mime: Column) -> Column:
    return F.when(mime == "image/png", "png").when(mime == "image/webp", "webp").otherwise("jpg")


def contains_any_pattern(text: Column, patterns) -> Column:
    """Whether any of some literal patterns is found; false without patterns."""
    found = F.lit(False)
    for pattern in patterns or ():
        found = found | text.rlike(pattern)
    return found
