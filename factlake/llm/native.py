"""Helpers of the operators that stay inside the JVM: spans of patterns as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,value:string,before:string>"
# So many code points before a match, back to the match before it at most.
CONTEXT = 24


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, also where ``use`` reads it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, combine) -> Column:
    """``combine`` of each entry of an array with all before it, for an associative ``combine``.

    Step k combines every entry with the one 2^k places before, so n entries
    take n log n work, where appending them one by one would copy n * n.
    """
    def step(done, width):
        return F.concat(
            F.slice(done, F.lit(1), width),
            F.zip_with(F.slice(done, width + 1, F.size(done) - width), F.slice(done, F.lit(1), F.size(done) - width),
                       combine),
        )

    def scanned(start):
        steps = F.ceil(F.log2(F.size(start).cast("double"))).cast("int")
        widths = F.transform(F.sequence(F.lit(1), steps), lambda k: F.pow(F.lit(2.0), k - 1).cast("int"))
        return F.when(F.size(start) > 1, F.aggregate(widths, start, step)).otherwise(start)

    return bound(values, scanned)


def spans(text: str, pattern: str, found: str) -> Column:
    """Where the matches listed in column ``found`` lie in ``text``, in code points.

    ``found`` is ``regexp_extract_all(text, pattern, 0)``; what lies between
    the matches gives their places.
    """
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    parts = F.zip_with(between, F.col(found), lambda gap, match: F.struct(
        (F.length(gap) + F.length(match)).alias("width"), match.alias("value"),
        F.substring(gap, -CONTEXT, CONTEXT).alias("before"),
    ))
    placed = bound(parts, lambda listed: F.zip_with(
        listed, running(F.transform(listed, lambda part: part["width"]), lambda one, other: one + other),
        lambda part, end: F.struct(
            (end - F.length(part["value"])).alias("start"), end.alias("end"),
            part["value"].alias("value"), part["before"].alias("before"),
        ),
    ))
    return F.when(F.size(found) > 0, placed).otherwise(no_spans())


_PIECE = 1024


def without_spans(text: Column, found: Column, mark: str) -> Column:
    """``text`` with each run of overlapping spans of ``found`` replaced by ``mark``.

    The text is cut into pieces of 1024 code points once, and what is kept is
    put together from them, so that a place far into the text is not counted
    from its beginning for every span.
    """
    def cut(pieces, start, end):
        first, last = F.floor(start / _PIECE).cast("int"), F.floor(end / _PIECE).cast("int")
        head, tail = start % _PIECE, end % _PIECE
        return F.when(start >= end, F.lit("")).when(
            first == last, F.substring(F.get(pieces, first), head + 1, end - start)
        ).otherwise(F.concat(
            F.substring(F.get(pieces, first), head + 1, F.lit(_PIECE)),
            F.array_join(F.slice(pieces, first + 2, last - first - 1), ""),
            F.coalesce(F.substring(F.get(pieces, last), F.lit(1), tail), F.lit("")),
        ))

    def replaced(pieces, ordered, reach):
        before = F.concat(F.array(F.lit(0)), reach)
        kept = F.zip_with(ordered, F.slice(before, F.lit(1), F.size(ordered)), lambda s, at: F.when(
            s["start"] >= at, F.concat(cut(pieces, at, s["start"]), F.lit(mark))
        ).otherwise(F.lit("")))
        return F.concat(F.array_join(kept, ""), cut(pieces, F.element_at(before, -1), F.length(text)))

    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))
    return bound(pieces, lambda p: bound(ordered, lambda o: bound(
        running(F.transform(o, lambda s: s["end"]), lambda one, other: F.greatest(one, other)), lambda reach: replaced(p, o, reach)
    )))


def matches(text: str, pattern: str, possible: Column) -> Column:
    """All matches where a cheap test says that there may be some."""
    return F.when(possible, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(
        F.array().cast("array<string>")
    )


def labelled(spans_: Column, kind: str, rank: int) -> Column:
    """Spans with their kind and the kind's rank in the listing."""
    return F.transform(spans_, lambda s: F.struct(
        F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
        s["start"].alias("start"), s["end"].alias("end"),
    ))


def joined(spans_: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string")
    )), ",")
