"""The part of a page that holds its paragraphs, by scores that rise from paragraphs to what holds them.

A paragraph of ``MIN_CHARS`` characters and more scores 1, 1 for each comma and 1 for each
hundred characters up to three. Its parent gets the score and its grandparent half of it, on top of what their
own name, class and id say about them. What is left of a score after taking off the share of text inside links
decides; siblings of the winner with a fifth of its score, and 10 at least, are kept beside it. Parents come from the labels
of :func:`~readaloud.functions.html.tree`, subtrees are their intervals, so a page is scored in one expression and stays in its row.
Scores are kept doubled, as integers, until the link share comes off.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.html import inner_tokens, text_of, tree
from ..functions.regex import let
from ..functions.text import collapse_whitespace, strip_ws

PARAGRAPHS = ("p", "pre", "td")
MIN_CHARS = 25
#: Twice the score that an element's name and its class or id give.
NAME_SCORES = {**dict.fromkeys(("div",), 10), **dict.fromkeys(("pre", "td", "blockquote"), 6),
               **dict.fromkeys(("address", "ol", "ul", "dl", "dd", "dt", "li", "form"), -6),
               **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6", "th"), -10)}
GOOD_NAME = "article|body|content|entry|main|page|post|story|text"
BAD_NAME = "comment|footer|footnote|menu|meta|promo|related|sidebar|sponsor|widget"
NAMED = 50
MIN_SIBLING, SIBLING_SHARE = 20, 0.2

_ATTRIBUTE = r"(?is)\s(?:class|id)\s*=\s*(?:\"[^\"]*(?:{0})|'[^']*(?:{0})|[^\s\"'>]*(?:{0}))"


def _own_score(tag: Column, name: Column) -> Column:
    score = F.lit(0)
    for value in sorted(set(NAME_SCORES.values())):
        score = F.when(name.isin(*[n for n, v in NAME_SCORES.items() if v == value]), value).otherwise(score)
    return score + F.when(tag.rlike(_ATTRIBUTE.format(GOOD_NAME)), NAMED).otherwise(0) - F.when(tag.rlike(_ATTRIBUTE.format(BAD_NAME)), NAMED).otherwise(0)


def _paragraphs(toks: Column, nodes: Column) -> Column:
    """(parent, grand, score) of the paragraphs that count; the text of one ends where the next one begins."""
    def scored(own):
        def one(n, i):
            stop = F.least(n["stop"], F.coalesce(F.get(own, i + 1)["pos"], n["stop"]))
            return let(strip_ws(collapse_whitespace(text_of(F.slice(toks, n["pos"] + 1, stop - n["pos"] - 1)))), lambda t: F.struct(
                n["parent"].alias("parent"), n["grand"].alias("grand"), F.length(t).alias("n"),
                (2 * (1 + F.length(t) - F.length(F.replace(t, F.lit(","))) + F.least(F.floor(F.length(t) / 100).cast("int"), F.lit(3)))).alias("score")))
        return F.filter(F.transform(own, one), lambda p: p["n"] >= MIN_CHARS)
    alive = F.filter(nodes, lambda n: n["name"].isin(*PARAGRAPHS) & (F.get(toks, n["pos"] - 1)["kind"] == "start"))
    return let(alive, scored)


def _text_chars(toks: Column) -> Column:
    return F.aggregate(toks, F.lit(0), lambda s, t: s + F.when(t["kind"] == "text", F.length(F.trim(t["text"]))).otherwise(0))


def scored_elements(toks: Column, nodes: Column) -> Column:
    """(pos, stop, name, parent, score) of every element that holds a paragraph, in document order."""
    def ranked(paragraphs):
        held = F.filter(nodes, lambda n: F.exists(paragraphs, lambda p: (p["parent"] == n["pos"]) | (p["grand"] == n["pos"])))
        links = F.transform(F.filter(nodes, lambda n: n["name"] == "a"), lambda n: F.struct(
            n["pos"].alias("pos"), _text_chars(inner_tokens(toks, n)).alias("n")))

        def score(n, ls):
            given = F.aggregate(paragraphs, F.lit(0), lambda s, p: s + F.when(p["parent"] == n["pos"], p["score"])
                                .when(p["grand"] == n["pos"], F.floor(p["score"] / 2).cast("int")).otherwise(0))
            linked = F.aggregate(ls, F.lit(0), lambda s, a: s + F.when((a["pos"] > n["pos"]) & (a["pos"] < n["stop"]), a["n"]).otherwise(0))
            share = linked / F.greatest(_text_chars(inner_tokens(toks, n)), F.lit(1))
            whole = given + _own_score(F.get(toks, n["pos"] - 1)["text"], n["name"])
            return F.struct(n["pos"].alias("pos"), n["stop"].alias("stop"), n["name"].alias("name"), n["parent"].alias("parent"),
                            (whole * (1 - share)).alias("score"))
        return let(links, lambda ls: F.transform(held, lambda n: score(n, ls)))
    return let(_paragraphs(toks, nodes), ranked)


def readable_part(toks: Column) -> Column:
    """(name, score, text) of the best element of a cleared page's tokens; null where no paragraph counts."""
    def part(nodes):
        def chosen(elements):
            best = F.array_max(F.transform(elements, lambda e: F.struct(e["score"].alias("score"), (-e["pos"]).alias("first"))))

            def beside(top):
                at = F.filter(elements, lambda e: e["pos"] == -top["first"])[0]
                return let(at, lambda w: F.struct(
                    w["name"].alias("name"), (w["score"] / 2).alias("score"),
                    F.array_join(F.transform(F.filter(elements, lambda e: (e["pos"] == w["pos"]) | (
                        (e["parent"] == w["parent"]) & (e["score"] >= F.greatest(F.lit(float(MIN_SIBLING)), w["score"] * SIBLING_SHARE)))),
                        lambda e: text_of(inner_tokens(toks, e))), "\n").alias("text")))
            return F.when(F.size(elements) > 0, let(best, beside))
        return let(scored_elements(toks, nodes), chosen)
    return let(tree(toks, implied=True), part)
