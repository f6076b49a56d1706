"""What the mark-up of a page hides from its readers, as column expressions.

The mark-up is cut into comments, script and style elements, tags and text by one pattern, and folded over a stack of open elements: an element is
hidden by its own inline style or because the one around it is. A closing tag closes everything up to the nearest open element of its name and is
ignored if there is none; void elements never open. Comments, scripts and styles are passed over as wholes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: elements without content
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
_TAG = r"</?[a-zA-Z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
TOKEN = (
    r"(?is)<!--.*?(?:-->|$)|<script\b[^>]*+>.*?(?:</script\s*>|$)|<style\b[^>]*+>.*?(?:</style\s*>|$)|<[!?][^>]*+>"
    rf"|{_TAG}|</?[a-zA-Z][^>]*+>|[^<]++|<")
STYLE = r"(?is)[\s\"'/]style\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))"
#: fixed values: named characters
NAMED = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": "\"", "&apos;": "'", "&amp;": "&"}


def unescaped(text: Column) -> Column:
    """Text with numeric and the usual named character references replaced."""
    reference = "(?i)&#(?:x[0-9a-f]{1,6}|[0-9]{1,7});"
    code = lambda r: F.when(r.rlike("(?i)^&#x"), F.conv(F.regexp_extract(r, "(?i)x([0-9a-f]+)", 1), 16, 10)).otherwise(
        F.regexp_extract(r, "([0-9]+)", 1)).cast("int")
    mark = lambda n: F.when(n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF), F.decode(
        F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(F.lit("�"))
    pieces = F.split(text, reference, -1)
    found = F.transform(F.regexp_extract_all(text, F.lit(reference), F.lit(0)), lambda r: mark(code(r)))
    joined = F.array_join(F.zip_with(pieces, found, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    plain = F.when(text.contains("&#"), joined).otherwise(text)
    for name, value in NAMED.items():
        plain = F.replace(plain, F.lit(name), F.lit(value))
    return F.when(text.contains("&"), plain).otherwise(text)


def _token(raw: Column, style: str) -> Column:
    """struct(kind, tag, hidden): kind is open, close, text or none."""
    name = F.lower(F.regexp_extract(raw, "^</?([a-zA-Z][^\\s/>]*)", 1))
    tag = (name != "") & ~raw.rlike("(?i)^<(?:script|style)[\\s/>]")
    inline = F.concat(*[F.regexp_extract(raw, STYLE, i) for i in (1, 2, 3)])
    kind = (
        F.when(tag & name.isin(*VOID), "none").when(tag & raw.startswith("</"), "close").when(tag & raw.endswith("/>"), "none")
        .when(tag, "open").when(raw.rlike("^<[!?]|^(?i)<(?:script|style)[\\s/>]"), "none").otherwise("text"))
    hidden = F.when(raw.contains("="), unescaped(inline).rlike(f"(?i){style}")).otherwise(F.lit(False))
    return F.struct(kind.alias("kind"), name.alias("tag"), (tag & hidden).alias("hidden"), raw.alias("raw"))


def hidden_fragments(html: Column, style: str) -> Column:
    """The pieces of text, in order, inside elements that ``style`` (a pattern over inline styles) hides. NULL has none.

    Pages without an inline style are not cut up at all. The stack holds the elements open at a place, the list only what was found hidden.
    """
    tokens = F.transform(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0)), lambda raw: _token(raw, style))
    start = F.struct(
        F.array().cast("array<struct<tag:string,hidden:boolean>>").alias("stack"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, token: Column) -> Column:
        stack = state["stack"]
        inside = F.coalesce(F.get(stack, F.size(stack) - 1)["hidden"], F.lit(False))
        opened = F.concat(stack, F.array(F.struct(token["tag"].alias("tag"), (token["hidden"] | inside).alias("hidden"))))
        depth = F.size(stack) - F.array_position(F.reverse(F.transform(stack, lambda e: e["tag"])), token["tag"]).cast("int")
        open_before = F.array_contains(F.transform(stack, lambda e: e["tag"]), token["tag"])
        closed = F.when(open_before, F.slice(stack, F.lit(1), F.greatest(depth, F.lit(0)))).otherwise(stack)
        return F.struct(
            F.when(token["kind"] == "open", opened).when(token["kind"] == "close", closed).otherwise(stack).alias("stack"),
            F.when((token["kind"] == "text") & inside, F.concat(state["out"], F.array(token["raw"]))).otherwise(state["out"]).alias("out"))

    found = F.transform(F.aggregate(tokens, start, step, lambda s: s["out"]), unescaped)
    return F.when(html.rlike("(?i)style\\s*="), found).otherwise(F.array().cast("array<string>"))
