"""HTML column functions: one tokenisation of a page, a labelled tree on it, and what is read from both.

:func:`tokens` cuts a page into an array of (kind, name, text): text, start and end tags, tags that
stand alone, and gaps (comments, declarations, raw-text elements). It reads each character once and knows quoted
attribute values, so markup inside an attribute or a script is no markup. :func:`tree` labels the elements
with the interval of tokens they span and their parent, as a tree builder nests them. Title, boilerplate
removal, main-element pick and text are all read from these two arrays; positions count tokens from 1 and stay what they
are when tokens are blanked.

All are Column -> Column compositions of built-in expressions (one regex and
higher-order array functions), so they need no Python worker. Text
nodes are joined with a newline.
"""
from __future__ import annotations

import html.entities
import json
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BOILERPLATE_TAGS, MAIN_ID_PATTERN
from .regex import let

# Attribute text: unquoted runs and quoted values. Runs are matched possessively
# so a long attribute or an unclosed tag is one loop, not one regex stack frame
# per character (java.util.regex recurses on repeated alternations).
ATTRS = "(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+"

# Elements whose content is not text (raw-text elements).
_RAW_TEXT = ("script", "style", "template")
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link",
         "meta", "source", "track", "wbr")

# One start tag, end tag, comment, declaration or processing instruction.
TAG = (r"(?s)<(?:[A-Za-z][^\s/>]*+" + ATTRS + r"|/[A-Za-z][^>]*+|!--.*?--|![^>]*+|\?[^>]*+)>")

# A comment, a raw-text element (an unclosed one runs to the end), an end tag, a start tag, a declaration or
# processing instruction, text, or a '<' that begins none of them: together they match every character once.
TOKEN = (rf"(?is)<!--.*?(?:-->|\z)|<({'|'.join(_RAW_TEXT)})(?![A-Za-z0-9])[^>]*+>.*?(?:</\1\s*+>|\z)"
         r"|</[A-Za-z][^>]*+>|<[A-Za-z][^\s/>]*+" + ATTRS + r">|<[!?][^>]*+>|[^<]++|<")
_HEAD = r"^</?([A-Za-z][^\s/>]*+)"

# Character references: numeric (decimal / hex) and named, ';' optional. Named
# ones use the HTML5 table; numeric 128-159 follow Windows-1252.
ENTITY = r"&(?:#[0-9]++|#[xX][0-9a-fA-F]++|[A-Za-z][A-Za-z0-9]*+);?"

# Names looked up in a small table before the full one.
COMMON_ENTITIES = ("hellip", "mdash", "ndash", "rsquo", "lsquo", "ldquo", "rdquo", "middot", "copy",
                   "nbsp", "apos", "quot", "gt", "lt", "amp")


@lru_cache(maxsize=1)
def _entity_pairs() -> tuple[tuple[str, str], ...]:
    """Named references: the HTML5 table shipped with Python, names without ';'."""
    names: dict[str, str] = {}
    for key, value in html.entities.html5.items():
        names.setdefault(key[:-1] if key.endswith(";") else key, value)
    return tuple(sorted(names.items()))


@lru_cache(maxsize=1)
def _cp1252_pairs() -> tuple[tuple[int, str], ...]:
    """Numeric references 128-159 name Windows-1252 characters in practice (by codec rule)."""
    out = []
    for n in range(128, 160):
        try:
            out.append((n, bytes([n]).decode("cp1252")))
        except UnicodeDecodeError:
            pass
    return tuple(out)


def _entity_map() -> Column:
    # One JSON literal parsed into a map (folded to a constant by the optimizer):
    # a 2k-entry map built from literals would put 4k nodes into every plan.
    return F.from_json(F.lit(json.dumps(dict(_entity_pairs()))), "map<string,string>")


def _cp1252_map() -> Column:
    return F.from_json(F.lit(json.dumps({str(k): v for k, v in _cp1252_pairs()})), "map<string,string>")


def _common_map() -> Column:
    table = dict(_entity_pairs())
    return F.from_json(F.lit(json.dumps({k: table[k] for k in COMMON_ENTITIES})), "map<string,string>")


def _decode_one(e: Column) -> Column:
    """Decode one matched character reference; unknown names stay as written."""
    name = F.regexp_extract(e, r"^&([A-Za-z][A-Za-z0-9]*);?$", 1)
    # leading zeros don't count; what is still too long for a code point is invalid
    hexd = F.regexp_extract(e, r"^&#[xX]0*([0-9a-fA-F]*);?$", 1)
    decd = F.regexp_extract(e, r"^&#0*([0-9]*);?$", 1)
    is_hex = F.lower(F.substring(e, 1, 3)) == "&#x"
    cp = F.when(is_hex, F.when(F.length(hexd) <= 6, F.conv(hexd, 16, 10).cast("bigint"))) \
        .otherwise(F.when(F.length(decd) <= 7, decd.try_cast("bigint")))
    cp = F.coalesce(cp, F.lit(0).cast("bigint"))
    valid = (cp > 0) & (cp <= 0x10FFFF) & ~cp.between(0xD800, 0xDFFF)
    as_char = F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")
    numeric = F.coalesce(F.try_element_at(_cp1252_map(), cp.cast("string")),
                         F.when(valid, as_char).otherwise(F.lit("\ufffd")))
    # frequent names first in a small table: a map literal lookup is a linear scan
    named = F.coalesce(F.try_element_at(_common_map(), name), F.try_element_at(_entity_map(), name), e)
    return F.when(name != "", named).otherwise(numeric)


def decode_entities(c: Column) -> Column:
    """Single-pass character-reference decoding (``&amp;lt;`` -> ``&lt;``)."""
    def body(x):
        pieces = F.split(x, ENTITY, -1)
        ents = F.regexp_extract_all(x, F.lit(ENTITY), 0)
        decoded = F.array_append(F.transform(ents, _decode_one), F.lit(""))
        joined = F.array_join(F.zip_with(pieces, decoded, lambda p, d: F.concat(p, d)), "")
        return F.when(F.instr(x, "&") > 0, joined).otherwise(x)
    return let(c, body)


#: Tokens labelled at a time: what is copied per token is at most so many labels.
_CHUNK = 256


def _token(t: Column, void: tuple[str, ...]) -> Column:
    name = F.when(F.startswith(t, F.lit("<")), F.lower(F.regexp_extract(t, _HEAD, 1))).otherwise("")
    return let(name, lambda n: F.struct(
        F.when(~F.startswith(t, F.lit("<")) | (t == "<"), "text").when(n == "", "gap").when(F.startswith(t, F.lit("</")), "end")
        .when(n.isin(*_RAW_TEXT), "gap").when((n.isin(*void) if void else F.lit(False)) | F.endswith(t, F.lit("/>")), "alone").otherwise("start").alias("kind"),
        n.alias("name"), t.alias("text")))


def tokens(html_col: Column, void: tuple[str, ...] = _VOID) -> Column:
    """The page as an array of (kind, name, text) whose texts, joined, are the page; ``void`` names the tags that never hold anything."""
    return F.transform(F.regexp_extract_all(html_col, F.lit(TOKEN), F.lit(0)), lambda t: _token(t, void))


#: Start tags that end an open paragraph, and the elements beyond which they don't reach.
_ENDS_P = ("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
           "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul")
_P_SCOPE = ("button", "caption", "table", "td", "th")


def tree(toks: Column, implied: bool = False, void: tuple[str, ...] = _VOID) -> Column:
    """The elements that can hold something, in document order: token position, position of the token that ends it, name, positions of its parent and grandparent.

    Nesting follows a tree builder: an end tag closes the nearest open element of its name and all inside, one without a
    start is ignored, what is never closed ends after the last token. An
    element without content stops where it starts. Position 0 is the document. With ``implied``, a block's start tag ends an
    open paragraph as in a browser; without it, paragraphs nest as in a lenient tree builder. The stack of open elements is folded over the tokens, in
    chunks, so that appending a token's label copies a chunk at most.
    """
    label = "array<struct<pos:int,opens:boolean,name:string,parent:int,grand:int,closed:array<int>>>"
    none = F.array().cast("array<int>")

    def state(names, opened, out):
        return F.struct(names.alias("names"), opened.alias("open"), out.alias("out"))

    def labelled_as(t, out, opened, opens, closed):
        above = [F.coalesce(F.get(opened, F.lit(i)), F.lit(0)).alias(n) for i, n in enumerate(("parent", "grand"))]
        return F.concat(out, F.array(F.struct(t["pos"].alias("pos"), F.lit(opens).alias("opens"), t["name"].alias("name"), *above, closed.alias("closed"))))

    def rest(stack, depth):
        return F.slice(stack, depth + 1, F.size(stack))

    def step(s, t):
        def start(names, opened, closed):
            return state(F.concat(F.array(t["name"]), names), F.concat(F.array(t["pos"]), opened), labelled_as(t, s["out"], opened, True, closed))

        def end(depth):
            # an end tag without a start changes nothing
            return F.when(depth == 0, s).otherwise(state(
                rest(s["names"], depth), rest(s["open"], depth), labelled_as(t, s["out"], s["open"], False, F.slice(s["open"], F.lit(1), depth))))

        def begin():
            if not implied:
                return start(s["names"], s["open"], none)
            depth = F.when(t["name"].isin(*_ENDS_P), F.array_position(s["names"], F.lit("p")).cast("int")).otherwise(0)
            return let(depth, lambda d: F.when(
                (d > 0) & ~F.arrays_overlap(F.slice(s["names"], F.lit(1), d), F.array(*[F.lit(n) for n in _P_SCOPE])),
                let(F.struct(rest(s["names"], d).alias("names"), rest(s["open"], d).alias("open")),
                    lambda r: start(r["names"], r["open"], F.slice(s["open"], F.lit(1), d)))).otherwise(start(s["names"], s["open"], none)))
        return F.when(t["kind"] == "start", begin()) \
            .when(t["kind"] == "end", let(F.array_position(s["names"], t["name"]).cast("int"), end)) \
            .otherwise(state(s["names"], s["open"], labelled_as(t, s["out"], s["open"], True, F.array(t["pos"]))))

    def chunk(tags):
        def run(s, at):
            inner = F.aggregate(F.slice(tags, at, _CHUNK), state(s["names"], s["open"], F.array().cast(label)), step)
            return let(inner, lambda r: F.struct(r["names"].alias("names"), r["open"].alias("open"),
                                                 F.concat(s["done"], F.array(r["out"])).alias("done")))
        return run

    def labelled(ts):
        # only tags that can hold something are folded
        tags = F.filter(F.transform(ts, lambda t, i: F.struct(t["kind"].alias("kind"), t["name"].alias("name"), (i + 1).alias("pos"))),
                        lambda t: t["kind"].isin("start", "end") | ((t["kind"] == "alone") & (~t["name"].isin(*void) if void else F.lit(True))))
        start = F.struct(F.array().cast("array<string>").alias("names"), none.alias("open"), F.array().cast(f"array<{label}>").alias("done"))
        end = let(tags, lambda x: F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(_CHUNK)), start, chunk(x)))
        return let(end, lambda e: let(F.flatten(e["done"]), lambda ls: nodes(ls, e["open"], F.size(ts) + 1)))

    def nodes(labels, left, last):
        # every element is closed once: the pairs in order of their starts go with the starts in order
        closed = F.flatten(F.transform(labels, lambda x: F.transform(x["closed"], lambda p: F.struct(p.alias("pos"), x["pos"].alias("stop")))))
        stops = F.array_sort(F.concat(closed, F.transform(left, lambda p: F.struct(p.alias("pos"), last.alias("stop")))))
        return F.zip_with(F.filter(labels, lambda x: x["opens"]), stops, lambda x, y: F.struct(
            x["pos"].alias("pos"), y["stop"].alias("stop"), x["name"].alias("name"), x["parent"].alias("parent"), x["grand"].alias("grand")))
    return let(toks, lambda ts: F.when(ts.isNotNull(), labelled(ts)))


def _blank(text: str) -> Column:
    return F.struct(F.lit("gap").alias("kind"), F.lit("").alias("name"), F.lit(text).alias("text"))


def without(toks: Column, nodes: Column, tags=BOILERPLATE_TAGS) -> Column:
    """The tokens with every element named in ``tags`` blanked, as many as before.

    The first token of a removed element, a raw-text element and a comment become an empty comment, so the text on
    either side stays two text nodes.
    """
    names = [t for t in tags if t not in _RAW_TEXT]

    def cut(s, n):
        return F.when(n["pos"] < s["at"], s).otherwise(F.struct(
            n["last"].alias("at"), F.concat(s["runs"], F.array(F.struct(s["at"].alias("a"), n["pos"].alias("b"), n["last"].alias("c")))).alias("runs")))

    def removed(ts):
        # an element goes with its own end tag, one that something else ends goes without that token
        ends = F.transform(F.filter(nodes, lambda n: n["name"].isin(*names) & (n["stop"] > n["pos"])), lambda n: F.struct(
            n["pos"].alias("pos"), (n["stop"] + F.when(F.get(ts, n["stop"] - 1)["name"] == n["name"], 1).otherwise(0)).alias("last")))
        start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<a:int,b:int,c:int>>").alias("runs"))
        return let(F.aggregate(ends, start, cut), lambda s: F.when(F.size(s["runs"]) == 0, ts).otherwise(F.concat(F.flatten(F.transform(
            s["runs"], lambda r: F.concat(F.slice(ts, r["a"], r["b"] - r["a"]), F.array(_blank("<!---->")), F.array_repeat(_blank(""), r["c"] - r["b"] - 1)))),
            F.slice(ts, s["at"], F.size(ts)))))
    plain = F.transform(toks, lambda t: F.when((t["kind"] == "gap") & ((t["name"] != "") | F.startswith(t["text"], F.lit("<!--"))), _blank("<!---->")).otherwise(t))
    return let(plain, removed)


def markup(toks: Column) -> Column:
    return F.array_join(F.transform(toks, lambda t: t["text"]), "")


def text_of(toks: Column) -> Column:
    """Text nodes of a run of tokens, joined by a newline, character references decoded."""
    def joined(ts):
        pieces = F.transform(ts, lambda t, i: F.when(t["kind"] != "text", "").when(
            (i > 0) & (F.get(ts, i - 1)["kind"] != "text"), F.concat(F.lit("\n"), t["text"])).otherwise(t["text"]))
        # the first text node has no neighbour before it
        return let(F.array_join(pieces, ""), lambda x: F.when(F.get(ts, F.lit(0))["kind"] != "text", F.substring(x, 2, 2 ** 31 - 1)).otherwise(x))
    return decode_entities(let(toks, joined))


def inner_tokens(toks: Column, node: Column) -> Column:
    """The tokens between an element's tags."""
    return F.slice(toks, node["pos"] + 1, F.greatest(node["stop"] - node["pos"] - 1, F.lit(0)))


def first_element(nodes: Column, toks: Column, name: str) -> Column:
    """The first element of that name that has not been blanked; null without one."""
    return F.get(F.filter(nodes, lambda n: (n["name"] == name) & (F.get(toks, n["pos"] - 1)["kind"] != "gap")), F.lit(0))


def title_of(toks: Column, nodes: Column) -> Column:
    """Text of the first <title>; NULL when absent, never closed, empty or not a single string."""
    return let(first_element(nodes, toks, "title"), lambda n: let(inner_tokens(toks, n), lambda ts: F.when(
        (F.size(ts) == 1) & (F.get(ts, F.lit(0))["kind"] == "text") & (F.get(toks, n["stop"] - 1)["name"] == "title"),
        decode_entities(F.get(ts, F.lit(0))["text"]))))


_ID = (rf"(?is)^<[^>]*?\sid\s*=\s*(?:\"[^\"]*(?:{MAIN_ID_PATTERN})[^\"]*\"|'[^']*(?:{MAIN_ID_PATTERN})[^']*'"
       rf"|[^\s\"'>]*(?:{MAIN_ID_PATTERN})[^\s>]*)")


def main_tokens(toks: Column, nodes: Column) -> Column:
    """The tokens of <article>, else <main>, else the first element with a content-like id, else all."""
    by_id = F.get(F.filter(nodes, lambda n: let(F.get(toks, n["pos"] - 1), lambda t: (t["kind"] != "gap") & t["text"].rlike(_ID))), F.lit(0))
    found = F.coalesce(first_element(nodes, toks, "article"), first_element(nodes, toks, "main"), by_id)
    return let(found, lambda n: F.when(n.isNotNull(), inner_tokens(toks, n)).otherwise(toks))


def body_tokens(toks: Column, nodes: Column) -> Column:
    """The tokens of <body>, or all when there is none."""
    return let(first_element(nodes, toks, "body"), lambda n: F.when(n.isNotNull(), inner_tokens(toks, n)).otherwise(toks))


def parsed(html_col: Column) -> Column:
    """(tokens, nodes) of a page: what a query that reads several things from it keeps as a column."""
    return let(tokens(html_col), lambda ts: F.struct(ts.alias("tokens"), tree(ts).alias("nodes")))


def cleared(page: Column, tags=BOILERPLATE_TAGS) -> Column:
    """A parsed page with the boilerplate blanked."""
    return F.struct(without(page["tokens"], page["nodes"], tags).alias("tokens"), page["nodes"].alias("nodes"))


# --- the same from markup to markup or text ----------------------------------

def drop_elements(html_col: Column, tags=BOILERPLATE_TAGS) -> Column:
    """Markup without comments, raw-text elements and the elements named in ``tags``."""
    return let(parsed(html_col), lambda p: markup(without(p["tokens"], p["nodes"], tags)))


def html_to_text(html_col: Column) -> Column:
    """Text nodes joined by a newline; raw-text elements contribute nothing."""
    # text without '<' has no markup: only the character references remain
    return let(html_col, lambda x: F.when(F.instr(x, "<") > 0, text_of(tokens(x))).otherwise(decode_entities(x)))


def page_title(html_col: Column) -> Column:
    """Text of the first <title>; NULL when absent, empty or not a single string."""
    return let(parsed(html_col), lambda p: title_of(p["tokens"], p["nodes"]))


def element_inner(html_col: Column, tag: str) -> Column:
    """Inner markup of the first <tag> element, NULL when there is none."""
    return let(parsed(html_col), lambda p: let(first_element(p["nodes"], p["tokens"], tag), lambda n: F.when(
        n.isNotNull(), markup(inner_tokens(p["tokens"], n)))))
