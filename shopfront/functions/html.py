"""Text, links and structured data of an HTML column, by regular expressions in the JVM.

There is no DOM here: elements are found by pattern over the whole page, tags are
removed to get the visible text, and the common character entities are decoded.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&commat;", "@"), ("&period;", "."), ("&amp;", "&")]
_NUMBERED = r"(?i)&#(?:x[0-9a-f]{1,6}|[0-9]{1,7});"
_QUOTED = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""
HREF = r"(?is)<a(?=\s)[^>]*?\shref\s*=\s*" + _QUOTED
ANCHOR = HREF + r"[^>]*>(.*?)</a\s*>"
LD_JSON = r"""(?is)<script\b[^>]*\stype\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script"""
JSON_STRING = r'"((?:[^"\\]|\\.)*)"'


def character(number: Column) -> Column:
    """The character of a code point; U+FFFD where there is none."""
    octet = lambda n: F.lpad(F.hex(n.cast("bigint")), 2, "0")
    shifted = lambda bits: F.shiftright(number, bits)
    tail = lambda bits: octet(shifted(bits).bitwiseAND(63) + 128)
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    code = (F.when(~F.coalesce(valid, F.lit(False)), "EFBFBD").when(number < 0x80, octet(number)).when(number < 0x800, F.concat(octet(shifted(6) + 192), tail(0)))
            .when(number < 0x10000, F.concat(octet(shifted(12) + 224), tail(6), tail(0)))
            .otherwise(F.concat(octet(shifted(18) + 240), tail(12), tail(6), tail(0))))
    return F.decode(F.unhex(code), "UTF-8")


def replaced(col: Column, pattern: str, by) -> Column:
    """Every match of the pattern replaced by what `by` makes of it, in one pass; text without a match is not touched.

    The text is bound to a name by way of a one-entry array, so that what computes it stands in the plan once.
    """

    def swapped(text: Column) -> Column:
        pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        joined = F.array_join(F.zip_with(pieces, found, lambda p, m: F.concat(p, F.coalesce(by(m), F.lit("")))), "")
        return F.when(text.rlike(pattern), joined).otherwise(text)

    return F.get(F.transform(F.array(col), swapped), F.lit(0))


def decode_numbered(col: Column) -> Column:
    """Numeric character references, decimal and hexadecimal, of any code point."""
    number = lambda m: F.when(m.rlike("(?i)^&#x"), F.conv(F.regexp_extract(m, "([0-9a-fA-F]+);", 1), 16, 10)).otherwise(F.regexp_extract(m, "([0-9]+);", 1))
    return replaced(col, _NUMBERED, lambda m: F.when(m.isNotNull(), character(number(m).cast("bigint"))))


def decode_entities(col: Column) -> Column:
    col = decode_numbered(col)
    for entity, char in _ENTITIES:
        col = F.replace(col, F.lit(entity), F.lit(char))
    return col


def unquote(col: Column) -> Column:
    return decode_entities(F.regexp_replace(col, r"""^["']|["']$""", ""))


def strip_tags(col: Column) -> Column:
    return decode_entities(F.regexp_replace(col, r"<[^>]*>", ""))


def body_text(html: Column) -> Column:
    """Visible text of the page body: scripts, styles, comments and tags removed, nothing put in their place."""
    visible = F.regexp_replace(html, _HIDDEN, "")
    return strip_tags(F.regexp_replace(visible, r"(?is)^.*?<body[^>]*>", ""))


def hrefs(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(HREF), 1), unquote)


def anchors(html: Column) -> Column:
    """Array of (href, text) of the page's links."""
    clean = lambda c: F.trim(F.regexp_replace(strip_tags(c), r"\s+", " "))
    whole = F.regexp_extract_all(html, F.lit(ANCHOR), 0)
    return F.transform(whole, lambda a: F.struct(
        unquote(F.regexp_extract(a, HREF, 1)).alias("href"), clean(F.regexp_extract(a, ANCHOR, 2)).alias("text")))


def attribute_values(html: Column, name: str) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)\s" + name + r"\s*=\s*" + _QUOTED), 1), unquote)


def ld_json(html: Column) -> Column:
    """Bodies of the page's ld+json scripts that hold valid JSON."""
    return F.filter(F.regexp_extract_all(html, F.lit(LD_JSON), 1), lambda s: F.try_parse_json(s).isNotNull())


def json_unescape(col: Column) -> Column:
    """The value of a JSON string literal without its quotes, read by the JSON parser."""
    return F.coalesce(F.get_json_object(F.concat(F.lit('{"v":"'), col, F.lit('"}')), "$.v"), col)


def ld_strings(html: Column, keys: str) -> Column:
    """String values of the given keys (an alternation), at any depth of the ld+json scripts."""
    found = F.flatten(F.transform(ld_json(html), lambda s: F.regexp_extract_all(s, F.lit(f'"(?:{keys})"\\s*:\\s*' + JSON_STRING), 1)))
    return F.transform(found, json_unescape)


def ld_same_as(html: Column) -> Column:
    """sameAs entries, given as one string or a list."""
    spans = F.flatten(F.transform(ld_json(html), lambda s: F.regexp_extract_all(
        s, F.lit(r'"sameAs"\s*:\s*("(?:[^"\\]|\\.)*"|\[[^\]]*\])'), 1)))
    return F.transform(F.flatten(F.transform(spans, lambda s: F.regexp_extract_all(s, F.lit(JSON_STRING), 1))), json_unescape)
