"""Column functions over HTML text: tags, attributes, character references and
links, as built-in expressions.

A page is cut into tokens by one regular expression whose first alternatives are
comments and the raw text of scripts and styles, so nothing inside these is taken
for a tag.  Tags and attribute names are read in any case, values quoted by
either quote or not at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_INSIDE = r"""(?:"[^"]*+"|'[^']*+'|[^'">]++){0,500}+>"""
_TOKEN = (r"(?is)<(?:!--(?:.*?-->|.*)|(script|style|noscript)\b" + _INSIDE + r"(?:.*?</\1\s*>|.*)|title\b" + _INSIDE
          + r"(?:.*?</title\s*>|.*)|[a-z]" + _INSIDE + ")")
_ATTRIBUTE = r"""(?s)[^\s"'<>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*))?"""
_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*"
# The named character references that are decoded (the ampersand last).
NAMED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " "}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside a lambda, where
    Catalyst shares no subexpressions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tags(html: Column) -> Column:
    """Start tags in order (a title with its text); comments, scripts and styles are left out."""
    return F.filter(F.regexp_extract_all(html, F.lit(_TOKEN), 0), lambda t: ~t.rlike(r"(?i)^<(!--|script\b|style\b|noscript\b)"))


def tag_name(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, r"^<([A-Za-z][^\s/>]*)", 1))


def attribute(tag: Column, name: str) -> Column:
    """Decoded value of the first attribute ``name`` of a start tag ('' without a
    value), NULL without the attribute."""
    parts = F.regexp_extract_all(F.regexp_extract(tag, r"(?s)^<[A-Za-z][^\s/>]*(.*)", 1), F.lit(_ATTRIBUTE), 0)
    own = F.get(F.filter(parts, lambda a: F.lower(F.regexp_extract(a, r"^[^\s=]+", 0)) == name), F.lit(0))
    value = F.regexp_extract(own, r"(?s)^[^\s=]+\s*=\s*(.*)$", 1)
    return decoded(_let(value, lambda v: F.when(v.rlike(r"""^["']"""), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)))


def title(tag_list: Column) -> Column:
    """Decoded text of the first title, '' without one."""
    own = F.get(F.filter(tag_list, lambda t: tag_name(t) == "title"), F.lit(0))
    text = F.regexp_replace(F.regexp_replace(own, "(?s)^<" + _INSIDE, ""), r"(?is)</title\s*>$", "")
    return F.coalesce(decoded(text), F.lit(""))


def decoded(text: Column) -> Column:
    """Character references replaced, each once: the named ones above and numeric
    ones that stand for a character."""
    def replaced(acc: Column, ref: Column) -> Column:
        is_hex = ref.rlike("^&#[xX]")
        digits = F.regexp_extract(ref, "^&#[xX]?([0-9a-fA-F]+)", 1)
        code = F.when(is_hex, F.conv(digits, 16, 10)).otherwise(F.regexp_extract(digits, "^[0-9]+", 0)).cast("bigint")
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(valid, F.replace(acc, ref, char)).otherwise(acc)

    def read(t: Column) -> Column:
        numbers = F.array_distinct(F.regexp_extract_all(t, F.lit("&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"), 0))
        out = F.aggregate(numbers, t, replaced)
        for ref, char in NAMED.items():
            out = F.replace(out, F.lit(ref), F.lit(char))
        return F.when(t.contains("&"), F.replace(out, F.lit("&amp;"), F.lit("&"))).otherwise(t)

    return _let(text, read)


def _without_dots(path: Column) -> Column:
    """`.` and `..` segments of a path resolved."""
    closed = F.regexp_replace(path, r"/(\.\.?)$", "/$1/")
    parts = F.aggregate(
        F.split(closed, "/"), F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc).when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.concat(acc, F.array(s))))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(parts, "/")).otherwise(path)


def address(base: Column) -> Column:
    """The parts of an absolute address that links resolve against."""
    path = F.regexp_extract(base, f"^{_SCHEME}://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(path, "[^/]*$", "")
    return F.struct(F.regexp_extract(base, f"^({_SCHEME}://[^/?#]*)", 1).alias("origin"), F.regexp_extract(base, f"^{_SCHEME}:", 0).alias("scheme"),
                    path.alias("path"), F.when(folder == "", "/").otherwise(folder).alias("folder"), F.regexp_replace(base, "#.*$", "").alias("page"))


def resolved(link: Column, base: Column) -> Column:
    """``link`` as an absolute address against ``base`` (of ``address``); as it is if ``base`` is none."""

    def joined(link: Column) -> Column:
        own = F.regexp_extract(link, "^[^?#]*", 0)
        whole = F.when(F.startswith(own, F.lit("/")), own).otherwise(F.concat(base["folder"], own))
        return F.concat(base["origin"], _let(whole, _without_dots), F.substring(link, F.length(own) + 1, F.length(link)))

    return _let(F.trim(link), lambda link: (
            F.when((base["origin"] == "") | link.rlike(f"^{_SCHEME}:"), link)
            .when(F.startswith(link, F.lit("//")), F.concat(base["scheme"], link))
            .when((link == "") | F.startswith(link, F.lit("#")), F.concat(base["page"], link))
            .when(F.startswith(link, F.lit("?")), F.concat(base["origin"], base["path"], link))
            .otherwise(joined(link))))
