"""CSS selectors over an event array, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageflow.functions.bind import bind
from pageflow.functions.running import running_max

# Fixed pattern: one simple selector of the supported grammar.
_SIMPLE = re.compile(
    r"""(?P<tag>[a-zA-Z][\w-]*|\*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|"""
    r"""\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[\^*$~]?=)\s*(?P<q>["']?)(?P<value>.*?)(?P=q)\s*(?P<flag>\s[iI])?\s*)?\]"""
)
_OUTSIDE_BRACKETS = r"(?![^\[]*\])"


def _test(found: re.Match, event: Column) -> Column:
    if found["tag"]:
        return F.lit(True) if found["tag"] == "*" else event["tag"] == found["tag"].lower()
    if found["cls"]:
        return F.concat(F.lit(" "), event["attrs"]["class"], F.lit(" ")).contains(f" {found['cls']} ")
    if found["id"]:
        return event["attrs"]["id"] == found["id"]
    have, op, want = event["attrs"][found["attr"].lower()], found["op"], found["value"]
    if op is None:
        return have.isNotNull()
    if found["flag"]:
        have, want = F.lower(have), want.lower()
    if op == "=":
        return have == want
    if not want:
        return F.lit(False)
    if op == "~=":
        return F.concat(F.lit(" "), have, F.lit(" ")).contains(f" {want} ")
    return {"^=": have.startswith, "$=": have.endswith, "*=": have.contains}[op](want)


def _compound(text: str, selector: str):
    tests, at = [], 0
    while at < len(text):
        found = _SIMPLE.match(text, at)
        if not found:
            raise ValueError(f"unsupported selector: {selector!r}")
        tests.append(found)
        at = found.end()
    if not tests:
        raise ValueError(f"unsupported selector: {selector!r}")

    def fits(event: Column) -> Column:
        out = event["kind"].isin("open", "void")
        for found in tests:
            out = out & _test(found, event)
        return F.coalesce(out, F.lit(False))

    return fits


def matching(events: Column, selector: str) -> Column:
    """The opening events of the elements a selector list matches, in order.

    Supported are tags, ``*``, classes, ids, attribute tests, compounds of
    these, descendants, children and comma lists; anything else raises here,
    when the plan is made.
    """
    alternatives = []
    for alternative in re.split("," + _OUTSIDE_BRACKETS, selector):
        text = re.sub(r"\s*>\s*" + _OUTSIDE_BRACKETS, " > ", alternative.strip())
        steps, child = [], False
        for token in re.split(r"\s+" + _OUTSIDE_BRACKETS, text):
            if token == ">":
                child = True
                continue
            steps.append((child, _compound(token, selector)))
            child = False
        if child or steps[0][0]:
            raise ValueError(f"unsupported selector: {selector!r}")
        alternatives.append(steps)

    def reaches(steps, event: Column) -> Column:
        """``event`` fits the last step and its ancestors the steps before."""
        (child, fits), before = steps[-1], steps[:-1]
        if not before:
            return fits(event)
        if child:
            place = event["parent"] - F.get(events, F.lit(0))["id"]
            parent = F.when(place >= 0, F.get(events, place))
            return fits(event) & bind(parent, lambda a: a.isNotNull() & F.coalesce(reaches(before, a), F.lit(False)))
        above = lambda a: (a["id"] < event["id"]) & (event["id"] <= a["last"])
        return fits(event) & F.exists(events, lambda a: above(a) & reaches(before, a))

    def matched(event: Column) -> Column:
        out = reaches(alternatives[0], event)
        for steps in alternatives[1:]:
            out = out | reaches(steps, event)
        return out

    return F.filter(events, matched)


# -- selectors that come as data ---------------------------------------------

# Fixed patterns: the parts of a selector in a column.
_COMPOUND = r"^(?:[a-zA-Z][\w-]*|\*)?(?:\.[\w-]+|#[\w-]+|\[[^\]]*\])*$"
_ATTRIBUTE = r"""^\s*([\w-]+)\s*(?:([\^*$~]?=)\s*["']?(.*?)["']?\s*(\s[iI])?\s*)?$"""


def _alternatives(selector: Column) -> Column:
    """Each alternative of a list as its tokens: compounds, and ``>`` before a child."""
    parts = F.split(selector, "," + _OUTSIDE_BRACKETS)
    spaced = lambda p: F.trim(F.regexp_replace(p, r"\s*>\s*" + _OUTSIDE_BRACKETS, " > "))
    return F.transform(parts, lambda p: F.split(spaced(p), r"\s+" + _OUTSIDE_BRACKETS))


def is_supported(selector: Column) -> Column:
    """Whether a selector in a column is a list of compounds, descendants and children."""

    def sound(tokens: Column) -> Column:
        child = lambda i: F.get(tokens, i) == ">"
        fits = F.transform(
            tokens,
            lambda t, i: F.when(t == ">", (i > 0) & (i < F.size(tokens) - 1) & ~F.coalesce(child(i - 1), F.lit(False)))
            .otherwise((t != "") & t.rlike(_COMPOUND)),
        )
        return F.forall(fits, lambda f: f)

    return F.forall(_alternatives(selector), sound)


def _compiled(selector: Column) -> Column:
    """Alternatives as arrays of steps (first, child, compound)."""

    def attribute(text: Column) -> Column:
        part = lambda i: F.regexp_extract(text, _ATTRIBUTE, i)
        flagged = part(4) != ""
        return F.struct(
            F.lower(part(1)).alias("name"),
            part(2).alias("op"),
            F.when(flagged, F.lower(part(3))).otherwise(part(3)).alias("want"),
            flagged.alias("flagged"),
        )

    def compound(text: Column) -> Column:
        outside = F.regexp_replace(text, r"\[[^\]]*\]", "")
        return F.struct(
            F.lower(F.regexp_extract(text, r"^([a-zA-Z][\w-]*)", 1)).alias("tag"),
            F.regexp_extract_all(outside, F.lit(r"\.([\w-]+)"), F.lit(1)).alias("classes"),
            F.regexp_extract(outside, r"#([\w-]+)", 1).alias("ident"),
            F.transform(F.regexp_extract_all(text, F.lit(r"\[([^\]]*)\]"), F.lit(1)), attribute).alias("attrs"),
        )

    def steps(tokens: Column) -> Column:
        every = F.transform(
            tokens,
            lambda t, i: F.when(
                t != ">",
                F.struct(
                    (i == 0).alias("first"),
                    F.coalesce(F.get(tokens, i - 1) == ">", F.lit(False)).alias("child"),
                    compound(t).alias("compound"),
                ),
            ),
        )
        return F.filter(every, lambda s: s.isNotNull())

    return F.transform(_alternatives(selector), steps)


def matching_column(events: Column, selector: Column) -> Column:
    """``matching`` for a selector that differs from row to row.

    An alternative is one fold over its steps.  Its state is, at the place of
    each element that fits so far, where that element ends.  A child looks at
    its parent's place.  A descendant looks at the running maximum before it:
    elements nest, so it lies in one of them if any ends behind its beginning.
    """

    def attribute_fits(event: Column, test: Column) -> Column:
        raw = event["attrs"][test["name"]]
        have = F.when(test["flagged"], F.lower(raw)).otherwise(raw)
        op, want = test["op"], test["want"]
        some = want != ""
        return F.coalesce(
            F.when(op == "", have.isNotNull())
            .when(op == "=", have == want)
            .when(op == "~=", some & F.contains(F.concat(F.lit(" "), have, F.lit(" ")), F.concat(F.lit(" "), want, F.lit(" "))))
            .when(op == "^=", some & F.startswith(have, want))
            .when(op == "$=", some & F.endswith(have, want))
            .otherwise(some & F.contains(have, want)),
            F.lit(False),
        )

    def fits(event: Column, c: Column) -> Column:
        classes = F.concat(F.lit(" "), F.coalesce(event["attrs"]["class"], F.lit("")), F.lit(" "))
        return (
            ((c["tag"] == "") | (c["tag"] == event["tag"]))
            & ((c["ident"] == "") | F.coalesce(event["attrs"]["id"] == c["ident"], F.lit(False)))
            & F.forall(c["classes"], lambda k: F.contains(classes, F.concat(F.lit(" "), k, F.lit(" "))))
            & F.forall(c["attrs"], lambda a: attribute_fits(event, a))
        )

    base = F.get(events, F.lit(0))["id"]
    nowhere = F.lit(-1)

    def advance(acc: Column, step: Column) -> Column:
        def reached(ends: Column) -> Column:
            def end(event: Column, i: Column) -> Column:
                below = (
                    F.when(step["first"], F.lit(True))
                    .when(step["child"], F.get(acc, event["parent"] - base) >= 0)
                    .otherwise(F.get(ends, i - 1) >= event["id"])
                )
                here = event["kind"].isin("open", "void") & F.coalesce(below, F.lit(False)) & fits(event, step["compound"])
                return F.when(here, event["last"]).otherwise(nowhere)

            return F.transform(events, end)

        return bind(F.when(~step["first"] & ~step["child"], running_max(acc)), reached)

    def found(alternatives: Column) -> Column:
        ends = F.transform(alternatives, lambda steps: F.aggregate(steps, F.array().cast("array<int>"), advance))
        return bind(ends, lambda every: F.filter(events, lambda e, i: F.exists(every, lambda a: F.get(a, i) >= 0)))

    return bind(_compiled(selector), found)


def covers(element: Column, event: Column) -> Column:
    return (element["id"] <= event["id"]) & (event["id"] <= element["last"])


def _outside(events: Column, found: Column) -> Column:
    """Events outside all elements found, for events without a gap, as a page or an element has.

    Elements lie side by side or within each other, so what is kept are the
    stretches between the outermost ones.  Each is cut out once.
    """
    step = F.struct(F.lit(-1).alias("until"), F.array().cast("array<struct<id:int,last:int>>").alias("outer"))

    def outermost(acc: Column, m: Column) -> Column:
        fresh = m["id"] > acc["until"]
        span = F.array(F.struct(m["id"].alias("id"), m["last"].alias("last")))
        return F.struct(
            F.when(fresh, m["last"]).otherwise(acc["until"]).alias("until"),
            F.when(fresh, F.concat(acc["outer"], span)).otherwise(acc["outer"]).alias("outer"),
        )

    outer = F.aggregate(found, step, outermost, lambda acc: acc["outer"])

    def stretches(spans: Column) -> Column:
        base = F.get(events, F.lit(0))["id"]
        starts = F.concat(F.array(base), F.transform(spans, lambda m: m["last"] + 1))
        ends = F.concat(F.transform(spans, lambda m: m["id"]), F.array(base + F.size(events)))
        gaps = F.arrays_zip(starts.alias("a"), ends.alias("b"))
        cut = F.transform(gaps, lambda g: F.slice(events, g["a"] - base + 1, F.greatest(g["b"] - g["a"], F.lit(0))))
        return F.when(F.size(spans) == 0, events).otherwise(F.flatten(cut))

    return bind(outer, stretches)


def _among(events: Column, found: Column) -> Column:
    """Of the elements found in a page those that lie in a stretch of it."""
    base = F.get(events, F.lit(0))["id"]
    return F.filter(found, lambda m: (m["id"] >= base) & (m["id"] < base + F.size(events)))


def without(events: Column, selector: str, page: Column | None = None) -> Column:
    """Events outside the elements a selector matches.

    ``page``: all events of the page of which ``events`` are a stretch, so that
    a combinator can name what lies around it.
    """
    if page is None or not re.search(r"[\s>]" + _OUTSIDE_BRACKETS, re.sub(r"\s*,\s*", ",", selector.strip())):
        return _outside(events, matching(events, selector))
    return _outside(events, _among(events, matching(page, selector)))


def without_column(events: Column, selector: Column, usual: str, page: Column) -> Column:
    """``without`` by a selector column; ``usual`` is the one most rows have."""
    return F.when(selector == usual, without(events, usual, page)).otherwise(
        _outside(events, _among(events, matching_column(page, selector)))
    )


def subtree(all_events: Column, element: Column) -> Column:
    """An element's events, cut out of the page's whole array by place."""
    return F.slice(all_events, element["id"] + 1, element["last"] - element["id"] + 1)


def inside(events: Column, element: Column) -> Column:
    """An element's events among those kept."""
    return F.filter(events, lambda e: covers(element, e))


def text_of(events: Column) -> Column:
    texts = F.filter(events, lambda e: e["kind"] == "text")
    return F.array_join(F.transform(texts, lambda e: e["text"]), "")
