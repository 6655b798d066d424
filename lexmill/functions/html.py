"""Regular-expression view of HTML pages: containers, text nodes, links.

Supported: one container per page, cut at its matching end tag; comments, scripts and styles are
skipped; character references are decoded. It is not a full parser of broken markup.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.numeric import let
from lexmill.functions.text import strip

REFERENCE = r"&(#[xX][0-9a-fA-F]+|#[0-9]+|[A-Za-z][A-Za-z0-9]*);"


def without_invisible(html: Column) -> Column:
    """Drop comments and the bodies of scripts and styles."""
    html = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    return F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")


def container(html: Column, tag: str, attribute: str | None = None) -> Column:
    """Inner HTML of the first ``tag`` (whose start tag matches ``attribute``); NULL if absent.

    Comments, scripts and styles are gone, so tags written inside them do not count. Nested elements of the same name are balanced.
    """
    start = rf"(?is)<{tag}\b(?=[^>]*{attribute})[^>]*>" if attribute else rf"(?is)<{tag}\b[^>]*>"
    rest = F.get(F.split(without_invisible(html), start, 2), F.lit(1))
    parts = F.split(rest, rf"(?i)(?=</?{tag}\b)")
    def step(acc: Column, part: Column) -> Column:
        change = F.when(part.rlike(rf"^(?i)</{tag}\b"), -1).when(part.rlike(rf"^(?i)<{tag}\b"), 1).otherwise(0)
        depth = acc["depth"] + F.when(acc["end"] < 0, change).otherwise(0)
        end = F.when((acc["end"] < 0) & (depth == 0), acc["at"]).otherwise(acc["end"])
        return F.struct(depth.alias("depth"), (acc["at"] + 1).alias("at"), end.alias("end"))

    # only the number of parts before the matching end tag is folded; the text is joined once
    opened = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("end"))
    inside = lambda p: F.aggregate(p, opened, step, lambda acc: F.when(acc["end"] < 0, acc["at"]).otherwise(acc["end"]))
    return let(parts, lambda p: F.array_join(F.slice(p, F.lit(1), inside(p)), ""))


def decode_references(c: Column) -> Column:
    """Named and numeric character references become characters, in one pass; unknown ones stay."""
    pieces = F.split(c, REFERENCE)
    names = F.from_json(F.lit(json.dumps({k[:-1]: v for k, v in html5.items() if k.endswith(";")})), "map<string,string>")

    def char(r: Column) -> Column:
        code = F.when(r.rlike("^#[xX]"), F.conv(F.substring(r, 3, 8), 16, 16)).otherwise(
            F.conv(F.substring(r, 2, 8), 10, 16)
        )
        numeric = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
        return F.when(r.startswith("#"), numeric).otherwise(
            F.coalesce(F.element_at(names, r), F.concat(F.lit("&"), r, F.lit(";")))
        )

    chars = F.transform(F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(1)), char)
    joined = F.array_join(F.zip_with(pieces, chars, lambda p, x: F.concat(p, F.coalesce(x, F.lit("")))), "")
    return F.when(c.contains("&"), joined).otherwise(c)


def text_nodes(html: Column) -> Column:
    """Stripped, non-empty text between the tags of cleaned HTML, in order."""
    nodes = F.split(html, r"<[^>]*>")
    return F.filter(F.transform(nodes, lambda t: strip(decode_references(t))), lambda t: t != "")


def visible_text(html: Column) -> Column:
    return F.array_join(text_nodes(without_invisible(html)), "\n")


def raw_text(html: Column) -> Column:
    """All text between the tags as it stands, joined by nothing: a phrase may run through inline tags."""
    nodes = F.split(without_invisible(html), r"<[^>]*>")
    return F.array_join(F.transform(nodes, decode_references), "")


_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
_OTHER = rf"""(?:\s+(?!href[\s=])[^\s=>"']+(?:\s*=\s*{_VALUE})?)*+"""


def hrefs(html: Column) -> Column:
    """Values of the ``href`` attributes of ``a`` tags: in double or single quotes, or bare."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<a{_OTHER}\s+href\s*=\s*({_VALUE})"), F.lit(1))
    plain = lambda v: F.when(v.rlike("^[\"']"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    return F.transform(found, lambda v: decode_references(plain(v)))


def without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; a query or fragment behind it stays as it is."""
    only, rest = F.regexp_extract(path, r"(?s)^([^?#]*)(.*)$", 1), F.regexp_extract(path, r"(?s)^([^?#]*)(.*)$", 2)

    def step(kept: Column, part: Column) -> Column:
        up = F.when(F.size(kept) > 1, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)
        return F.when(part == ".", kept).when(part == "..", up).otherwise(F.array_append(kept, part))

    ends_in_folder = only.rlike(r"(^|/)\.{1,2}$")
    joined = F.array_join(F.aggregate(F.split(only, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(only.rlike(r"(^|/)\.{1,2}(/|$)"), F.concat(joined, F.when(ends_in_folder, F.lit("/")).otherwise(F.lit("")), rest)).otherwise(path)


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute URL of an absolute, ``//host``, ``/path`` or relative link."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*:)", 1)
    host = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*://[^/?#]*)", 1)
    page = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(page == host, F.lit("/")).otherwise(F.substring(F.regexp_replace(page, r"[^/]*$", ""), F.length(host) + 1, F.length(page)))
    return (
        F.when(href.rlike(r"^[a-zA-Z][\w+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(host, without_dots(href)))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href.startswith("?"), F.concat(page, href))
        .otherwise(F.concat(host, without_dots(F.concat(folder, href))))
    )
