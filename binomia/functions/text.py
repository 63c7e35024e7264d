"""String functions: patterns of scientific names, matches with offsets, HTML, splicing."""

from __future__ import annotations

import json
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. White space as ECMAScript has it, and ASCII word edges: Java's own are Unicode's.
WS = "[\\t\\n\\x0B\\f\\r \\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
EDGE_R = "(?![A-Za-z0-9_])"
CAPITAL = "[A-Z](?<![A-Za-z0-9_][A-Z])"  # the first letter of a word; what is before it is looked at only where there is a capital
CANDIDATE = f"({CAPITAL}[a-z]{{2,}}){WS}+([a-z]{{3,}}){EDGE_R}"
HYPHENATED = f"({CAPITAL}[a-z]{{2,}}){WS}+([a-z]-[a-z]{{2,}}){EDGE_R}"
SHORT_GENUS = f"({CAPITAL}[a-z]){WS}+([a-z]{{3,}}){EDGE_R}"
EITHER = f"({CAPITAL}[a-z]+){WS}+([a-z]{{3,}}|[a-z]-[a-z]{{2,}}){EDGE_R}"  # all three: their matches never overlap
ASCII_WS = "[\\t\\n\\f\\r ]"  # white space as DuckDB's patterns have it
WORD = "[a-zA-Z][-a-zA-Z]*"
MARK = "\x00"  # put around matches, so that a split by one character takes them apart


def starts(lengths: Column) -> Column:
    """The sum of the lengths before each; by blocks of a square root's size, as a running sum over one array copies it for each element."""
    n = F.size(lengths)
    block = F.ceil(F.sqrt(n)).cast("int")
    none = F.array().cast("array<int>")
    run = lambda xs: F.aggregate(xs, F.struct(F.lit(0).alias("at"), none.alias("seen")), lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["seen"], s["at"]).alias("seen")))
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(n / block).cast("int") - 1), lambda k: run(F.slice(lengths, k * block + 1, block)))

    def shifted(b: Column) -> Column:
        before = run(F.transform(b["blocks"], lambda x: x["at"]))["seen"]
        return F.flatten(F.zip_with(b["blocks"], before, lambda x, at: F.transform(x["seen"], lambda y: y + at)))

    return F.when(n == 0, none).otherwise(bound(F.struct(blocks.alias("blocks")), shifted))


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """Array of (idx, text, g1, g2): each match of a pattern with two groups, its offset in code points.

    One pass of the pattern marks the matches and their groups, and a split by the mark gives them and the text between them, so that offsets are running sums of lengths. A text that holds
    the mark itself is split by the pattern instead.
    """

    def placed(b: Column) -> Column:
        found = b["found"]
        gaps = F.transform(F.slice(b["between"], F.lit(1), F.size(found)), lambda g: F.length(g))
        at = bound(F.zip_with(gaps, found, lambda g, m: g + F.length(m)), starts)
        return F.arrays_zip(F.zip_with(at, gaps, lambda a, g: a + g).alias("idx"), found.alias("text"), b["g1"].alias("g1"), b["g2"].alias("g2"))

    names = ("between", "found", "g1", "g2")
    every = lambda parts, k: F.filter(parts, lambda _, i: i % 4 == k)
    marked = bound(F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}$1{MARK}$2{MARK}"), MARK, -1), lambda p: F.struct(*(every(p, k).alias(c) for k, c in enumerate(names))))
    plain = F.struct(F.split(text, pattern, -1).alias("between"), *(F.regexp_extract_all(text, F.lit(pattern), F.lit(k)).alias(c) for k, c in enumerate(names[1:])))
    return bound(F.when(F.contains(text, F.lit(MARK)), plain).otherwise(marked), placed)


# Fixed values. White space as Unicode has it, which a class of HTML text may hold after its entities are decoded.
BLANK = "[\\t-\\r\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
HIDDEN = "(?is)<!--.*?-->|<(script|style|template)\\b.*?</\\1\\s*>"
ENTITY = "&(?:#[0-9]{1,7};?|#[xX][0-9A-Fa-f]{1,6};?|[A-Za-z][A-Za-z0-9]*;?)"


@cache
def named_entities() -> str:
    """HTML's named characters as JSON, by their first two letters and then by name, as the standard library has them, with the semicolon or without; and those of Windows for the numbers that stand for no character."""
    numbers = {f"#{i}": bytes([i]).decode("cp1252", "ignore") for i in range(128, 160)}
    out: dict[str, dict[str, str]] = {}
    for name, chars in [*sorted(html5.items()), *numbers.items()]:
        if chars:
            out.setdefault(name[:2], {})[name] = chars
    return json.dumps(out)


def unescape(text: Column) -> Column:
    """Entities as characters, by number or name; an unknown name, or a number that is no character, stays."""
    # names by their first two letters: maps are searched entry by entry, so each holds few
    tables = F.from_json(F.lit(named_entities()), "map<string,map<string,string>>")
    known = lambda name: F.try_element_at(F.try_element_at(tables, F.left(name, F.lit(2))), name)

    def char(e: Column) -> Column:
        hexed = F.conv(F.regexp_extract(e, "^&#[xX]([0-9A-Fa-f]+)", 1), 16, 10).cast("int")
        number = F.when(F.startswith(F.lower(e), F.lit("&#x")), hexed).otherwise(F.regexp_extract(e, "^&#([0-9]+)", 1).cast("int"))
        fits = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        wide = F.when(number.between(128, 159), F.coalesce(known(F.concat(F.lit("#"), number)), e)).otherwise(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        name = F.substring(e, F.lit(2), F.length(e))
        by_name = F.coalesce(known(name), known(F.concat(name, F.lit(";"))))
        return F.coalesce(F.when(F.startswith(e, F.lit("&#")), F.when(fits, wide)).otherwise(by_name), e)

    def decoded(b: Column) -> Column:
        each = F.zip_with(b["between"], b["found"], lambda g, e: F.concat(g, F.when(e.isNull(), "").otherwise(char(e))))
        return F.array_join(each, "")

    parts = F.struct(F.split(text, ENTITY, -1).alias("between"), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)).alias("found"))
    return F.when(F.contains(text, F.lit("&")), bound(parts, decoded)).otherwise(text)


def html_text(html: Column) -> Column:
    """What a page shows: scripts, styles and comments left out, tags to spaces, entities decoded, runs of white space to one space, none before a comma."""
    out = unescape(F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), "<[^>]*>", " "))
    return F.regexp_replace(F.regexp_replace(out, BLANK + "+", " "), " +,", ",")


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def splice(text: Column, spans: Column) -> Column:
    """text with each span (idx, end, new) of an ordered array replaced; spans don't overlap.

    The text is cut as four bytes a letter, where a place is found without reading what is before it: time grows with the text, not with text times spans.
    """

    def pieces(b: Column) -> Column:
        end_of = lambda i: F.when(i == 0, 0).otherwise(F.get(b["spans"], i - 1)["end"])
        cut = lambda since, n: F.decode(F.substring(b["wide"], 4 * since + 1, 4 * n), "UTF-32")
        each = F.transform(b["spans"], lambda x, i: F.concat(cut(end_of(i), x["idx"] - end_of(i)), x["new"]))
        last = end_of(F.size(b["spans"]))
        return F.array_join(F.array_append(each, cut(last, F.octet_length(b["wide"]))), "")

    return bound(F.struct(spans.alias("spans"), F.encode(text, "UTF-32").alias("wide")), pieces)
