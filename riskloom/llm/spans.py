"""Spans of pattern matches in code points, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<s:int,e:int,m:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blocks(items: Column) -> Column:
    """An array cut into consecutive blocks of about the square root of its length.

    A fold that appends to an array copies it at each step. Within blocks, and
    then over blocks, n steps copy n * sqrt(n) entries instead of n * n.
    """
    n = F.size(items)
    width = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
    heads = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), width), lambda i: i < n)
    return F.transform(heads, lambda i: F.slice(items, i + 1, width))


def _before(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """What ``add`` makes, from 0 on, of the values before each."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, start, lambda acc, v: F.struct(
        add(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def placed(found: Column) -> Column:
    """SPAN of struct(gap, hit, m): lengths of the text before each hit since the last, and the hits."""
    def end(at: Column, x: Column) -> Column:
        return at + x["gap"] + F.length(x["hit"])

    def step(acc: Column, x: Column) -> Column:
        e = end(acc["at"], x)
        one = F.struct((e - F.length(x["hit"])).alias("s"), e.alias("e"), x["m"].alias("m"))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def within(block: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(block, start, step, lambda acc: acc["out"])

    return let(blocks(found), lambda parts: F.flatten(F.zip_with(
        parts, _before(F.transform(parts, lambda b: F.aggregate(b, F.lit(0), end)), lambda at, v: at + v), within)))


def matches(text: Column, pattern: str, may: Column, group: int | None = None) -> Column:
    """array<struct(s, e, m)> of the leftmost non-overlapping matches; end exclusive.

    The text's pieces between matches and the matches themselves give the
    positions as running lengths. ``may`` is a cheap test that every text with a
    match passes. ``m`` is the match, or its group ``group``.
    """
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    zipped = F.arrays_zip(pieces.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
                          F.regexp_extract_all(text, F.lit(pattern), F.lit(group or 0)).alias("m"))
    found = F.filter(zipped, lambda x: x["hit"].isNotNull())
    return F.when(may, let(found, placed)).otherwise(F.array().cast(SPAN))


def named(spans: Column, kind: str, order: int) -> Column:
    """Add the kind's name and its place in the listed order: struct(s, k, e, kind, m)."""
    return F.transform(spans, lambda x: F.struct(
        x["s"].alias("s"), F.lit(order).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"), x["m"].alias("m")))


def listed(spans: Column) -> Column:
    """kind:start:end of spans in their order, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    """Overlapping spans (sorted by start) as one each: struct(s, e, kind of the first)."""
    def farthest(at: Column, x: Column) -> Column:
        return F.greatest(at, x["e"])

    def step(acc: Column, x: Column) -> Column:
        one = F.struct(x["s"].alias("s"), acc["at"].alias("before"), x["kind"].alias("kind"))
        return F.struct(farthest(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def within(block: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast("array<struct<s:int,before:int,kind:string>>").alias("out"))
        return F.aggregate(block, start, step, lambda acc: acc["out"])

    def merged(heads: Column, last: Column) -> Column:
        # a group ends at the farthest end before the next group's first span
        return F.zip_with(heads, F.slice(heads, 2, F.size(heads)), lambda a, b: F.struct(
            a["s"].alias("s"), F.coalesce(b["before"], last).alias("e"), a["kind"].alias("kind")))

    def whole(x: Column) -> Column:
        marked = let(blocks(x), lambda parts: F.flatten(F.zip_with(
            parts, _before(F.transform(parts, lambda b: F.aggregate(b, F.lit(0), farthest)), F.greatest), within)))
        last = F.array_max(F.transform(x, lambda y: y["e"]))
        return let(F.filter(marked, lambda y: y["s"] >= y["before"]), lambda heads: merged(heads, last))

    return let(spans, whole)


def rebuilt(text: Column, spans: Column, instead: Callable[[Column], Column]) -> Column:
    """The text with each of its non-overlapping ``spans`` x (sorted) replaced by ``instead(x)``.

    Each block of spans cuts its own stretch of the text, so that positions are
    sought in that stretch alone.
    """
    def stretch(block: Column, start: Column) -> Column:
        part = F.substring(text, start + 1, F.element_at(block, -1)["e"] - start)
        zero = F.struct(start.alias("at"), F.array().cast("array<string>").alias("out"))

        def cut(t: Column) -> Column:
            return F.aggregate(block, zero, lambda acc, x: F.struct(x["e"].alias("at"), F.concat(acc["out"], F.array(
                F.substring(t, acc["at"] - start + 1, x["s"] - acc["at"]), instead(x))).alias("out")),
                lambda acc: F.array_join(acc["out"], ""))
        return let(part, cut)

    def whole(parts: Column) -> Column:
        ends = F.transform(parts, lambda b: F.element_at(b, -1)["e"])
        last = F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0))
        starts = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))))
        return F.concat(F.array_join(F.zip_with(parts, F.slice(starts, 1, F.size(parts)), stretch), ""),
                        F.substring(text, last + 1, F.length(text)))

    return let(spans, lambda x: let(blocks(x), whole))


def replaced(text: Column, spans: Column, by: dict[str, str]) -> Column:
    """The text with non-overlapping ``spans`` replaced by what ``by`` names for their kind."""
    names = F.create_map(*[F.lit(v) for kv in by.items() for v in kv])
    return rebuilt(text, spans, lambda x: names[x["kind"]])
