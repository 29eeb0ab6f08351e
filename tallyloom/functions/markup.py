"""Visible text of HTML pages as column expressions: nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*+(?:>.*?(?:</\1\b[^>]*+(?:>|\z)|\z)|\z)"
_BODY = r"(?is)^.*?<body\b[^>]*+>(.*?)(?:</body\b|\z)"
#: A tag ends at the first ``>`` outside of quoted values, or with the page.
_TAG = r"""(?s)<(?:[A-Za-z](?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))?+)*+|[/!?][^>]*+)(?:>|\z)"""
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)"
_BARE = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
_NAMES = "\x02".join(f"{n}\x01{c}" for n, c in html5.items())
_COMMON = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": "\xa0"}
#: What pages of the Windows code page mean by the numbers 128 to 159.
_WINDOWS = [bytes([k]).decode("cp1252", "replace").replace("�", chr(k)) for k in range(128, 160)]


def _numbered(code: Column) -> Column:
    """The character of a number: surrogates and numbers beyond Unicode give U+FFFD, control signs and non-characters nothing."""
    bad = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    none = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    old = F.element_at(F.array(*map(F.lit, _WINDOWS)), (F.when(code.between(128, 159), code).otherwise(128) - 127).cast("int"))
    sign = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(bad, F.lit("�")).when(none, F.lit("")).when(code.between(128, 159), old).otherwise(sign)


def _character(e: Column) -> Column:
    """What one reference stands for; a name without its semicolon may go on, and an unknown one stays as it is."""
    names = F.str_to_map(F.lit(_NAMES), F.lit("\x02"), F.lit("\x01"))  # folded into one literal
    tens, sixteens = F.ltrim(F.regexp_extract(e, "^&#([0-9]+)", 1), F.lit("0")), F.ltrim(F.regexp_extract(e, "^&#[xX]([0-9a-fA-F]+)", 1), F.lit("0"))
    code = F.when(F.greatest(F.length(tens), F.length(sixteens)) > 7, F.lit(0x110000)).when(sixteens != "", F.conv(sixteens, 16, 10).try_cast("bigint")).otherwise(F.coalesce(tens.try_cast("bigint"), F.lit(0)))
    prefix = F.regexp_extract(e, f"^&({_BARE})", 1)
    named = F.coalesce(F.try_element_at(names, F.substr(e, F.lit(2))), F.when(prefix != "", F.concat(F.try_element_at(names, prefix), F.substr(e, F.length(prefix) + 2))), e)
    common = F.lit(None).cast("string")
    for name, sign in _COMMON.items():
        common = F.when(e == name, F.lit(sign)).otherwise(common)
    return F.coalesce(common, F.when(F.startswith(e, F.lit("&#")), _numbered(code)).otherwise(named))


def _once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(c), use), 1)


def unescaped(c: Column) -> Column:
    """Named and numbered character references as their characters."""

    def whole(t: Column) -> Column:
        between, found = F.split(t, _REFERENCE), F.regexp_extract_all(t, F.lit(_REFERENCE), F.lit(0))
        joined = F.array_join(F.zip_with(between, F.transform(found, _character), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        return F.when(F.contains(t, F.lit("&")), joined).otherwise(t)

    return _once(c, whole)


def visible_text(page: Column) -> Column:
    """Text of the body, or of the whole page without one; tags part words, white space is squeezed.

    Scripts, styles and comments are no text, and neither is a tag that the page's end cuts; null and empty pages give
    the empty string.
    """
    shown = F.regexp_replace(F.coalesce(page, F.lit("")), _HIDDEN, " ")
    body = _once(shown, lambda s: F.when(s.rlike(r"(?i)<body\b[^>]*>"), F.regexp_extract(s, _BODY, 1)).otherwise(s))
    text = unescaped(F.regexp_replace(body, _TAG, " "))
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
