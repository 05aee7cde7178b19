"""Spans: finding them, resolving overlaps, merging, replacing, exploding.

A span is ``struct(type, value, start, end, confidence, rank, metadata)`` with
half-open code-point offsets, so ``substring(text, start + 1, end - start)`` is
``value``. Everything here is a column expression: detection is a map over rows
and never shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.text import MARK, SPACE, as_column, has_rare, let, plain_spaces

SPAN = (
    "struct<type:string,value:string,start:int,end:int,confidence:double,"
    "rank:int,metadata:map<string,string>>"
)
SPANS = f"array<{SPAN}>"

# Marks both ends of a match while a text is being split.
_MARK = MARK
# Parts of a block; even.
_BLOCK = 64
# Parts of which each match's place is summed up by itself; even more go in blocks.
_PARTS = 33
# Spans that are compared with each other directly; more are first cut where none overlap.
_FEW = 32


def no_spans() -> Column:
    return F.array().cast(SPANS)


def _in_blocks(items: Column) -> Column:
    """An array cut into arrays of ``_BLOCK``."""
    last = lambda whole: F.floor((F.size(whole) - 1) / _BLOCK).cast("int")
    return let(
        items,
        lambda whole: F.transform(F.sequence(F.lit(0), last(whole)), lambda k: F.slice(whole, k * _BLOCK + 1, F.lit(_BLOCK))),
    )


def _scan(items: Column, total: Callable[[Column], Column], add: Callable[[Column, Column], Column], run: Callable[[Column, Column], Column]) -> Column:
    """Join what ``run(block, number)`` makes of each block of a non-empty array; ``number`` is what ``add``
    makes, from 0, of the ``total`` of each block before it.

    Growing an array copies it. A run over a block copies little, whatever the array's length.
    """

    def before(blocks: Column) -> Column:
        start = F.struct(F.lit(0).alias("now"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, block: F.struct(
            add(acc["now"], total(block)).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out")
        )
        return F.aggregate(blocks, start, step, lambda acc: acc["out"])

    return let(_in_blocks(items), lambda blocks: F.flatten(F.zip_with(blocks, before(blocks), run)))


def fenced_hits(parts: Column) -> Column:
    """``array<struct(value, start)>`` of every second part of a text that was cut around its matches.

    Few parts are joined natively up to each match: that costs less than a fold, whose steps Spark interprets.
    """
    none = F.array().cast("array<struct<value:string,start:int>>")
    one = lambda value, start: F.struct(value.alias("value"), start.alias("start"))

    def located(cut: Column) -> Column:
        n = F.size(cut)
        each = F.transform(
            F.sequence(F.lit(1), n - 2, F.lit(2)), lambda i: one(F.get(cut, i), F.length(F.array_join(F.slice(cut, F.lit(1), i), "")))
        )
        single = F.array(one(F.get(cut, F.lit(1)), F.length(F.get(cut, F.lit(0)))))
        return F.when(n <= 1, none).when(n == 3, single).when(n <= _PARTS, each).otherwise(_folded_hits(cut))

    return let(parts, located)


def _folded_hits(parts: Column) -> Column:
    """``fenced_hits`` of any number of parts, in time linear in the text."""
    none = F.array().cast("array<struct<value:string,start:int>>")

    def step(acc: Column, part: Column) -> Column:
        found = F.array(F.struct(part.alias("value"), acc["pos"].alias("start")))
        return F.struct(
            (acc["pos"] + F.length(part)).alias("pos"),
            (~acc["hit"]).alias("hit"),
            F.when(acc["hit"], F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"),
        )

    # a block holds an even number of parts, so each begins outside a match
    start = lambda at: F.struct(at.alias("pos"), F.lit(False).alias("hit"), none.alias("out"))
    return _scan(
        parts,
        lambda block: F.length(F.array_join(block, "")),
        lambda a, b: a + b,
        lambda block, at: F.aggregate(block, start(at), step, lambda acc: acc["out"]),
    )


def make_span(type_, value, start, confidence, metadata: Column) -> Column:
    """One span; the end follows from the value's length."""
    as_lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_lit(type_).cast("string").alias("type"),
        value.alias("value"),
        start.cast("int").alias("start"),
        (start + F.length(value)).cast("int").alias("end"),
        as_lit(confidence).cast("double").alias("confidence"),
        F.lit(0).alias("rank"),
        metadata.alias("metadata"),
    )


def metadata(values: Mapping[str, object] | None = None) -> Column:
    """``map<string,string>`` from constants and columns."""
    if not values:
        return F.create_map().cast("map<string,string>")
    flat = []
    for key, value in values.items():
        flat += [F.lit(key), (value if isinstance(value, Column) else F.lit(value)).cast("string")]
    return F.create_map(*flat)


def find_spans(
    text,
    pattern: str,
    type_,
    confidence,
    *,
    group: Callable[[Column], Column] | None = None,
    group_offset: Callable[[Column, Column], Column] | None = None,
    derive: Callable[[Column], Column] | None = None,
    worth: Callable[[Column], Column] | None = None,
    keep: Callable[..., Column] | None = None,
    before: tuple[int, Callable[[Column], Column]] | None = None,
    meta: Callable[..., Mapping[str, object]] | Mapping[str, object] | None = None,
    when: Column | None = None,
) -> Column:
    """All matches of a Java ``pattern`` as spans.

    The text is taken as it is: :func:`scan` gives it without marks and wide spaces.

    ``group`` narrows the match to a part of it (an empty part drops it),
    ``keep`` filters on the value, ``before`` on the given number of characters
    in front of it. ``derive`` computes a column from the value once per match that is ``worth`` it;
    ``keep``, ``type_``, ``confidence`` and ``meta`` may be functions of the value,
    and of that column if there is one. ``when`` is a cheap test that spares the pattern.

    Spark has no built-in that returns match positions, so matches are fenced
    with a mark, the text is split on it, and lengths are summed up. The pattern runs once over a
    text; one that comes out as it was has no match.
    """
    text = as_column(text)

    def located(fenced: Column) -> Column:
        return F.when(fenced != text, spans_of(fenced_hits(F.split(fenced, _MARK, -1)))).otherwise(no_spans())

    def pick(given, hit: Column):
        if isinstance(given, Column) or not callable(given):
            return given
        return given(hit["value"], hit["derived"]) if derive is not None else given(hit["value"])

    def to_span(hit: Column) -> Column:
        return make_span(
            pick(type_, hit), hit["value"], hit["start"], pick(confidence, hit), metadata(pick(meta, hit))
        )

    def spans_of(hits: Column) -> Column:
        return F.transform(narrowed(hits), to_span)

    def narrowed(hits: Column) -> Column:
        if group is not None:
            offset = group_offset or (lambda whole, part: F.instr(whole, part) - 1)
            hits = F.transform(
                hits,
                lambda h: let(
                    group(h["value"]),
                    lambda part: F.struct(
                        part.alias("value"), (h["start"] + offset(h["value"], part)).alias("start")
                    ),
                ),
            )
            hits = F.filter(hits, lambda h: h["value"] != "")
        if before is not None:
            width, accept = before
            hits = F.filter(
                hits,
                lambda h: accept(
                    F.substr(
                        text,
                        F.greatest(h["start"] - width, F.lit(0)) + 1,
                        F.least(h["start"], F.lit(width)),
                    )
                ),
            )
        if worth is not None:
            hits = F.filter(hits, lambda h: worth(h["value"]))
        if derive is not None:
            hits = F.transform(hits, lambda h: h.withField("derived", derive(h["value"])))
        if keep is not None:
            hits = F.filter(hits, lambda h: pick(keep, h))
        return hits

    found = let(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), located)
    return found if when is None else F.when(when, found).otherwise(no_spans())


def scan(text, body: Callable[[Column], Column]) -> Column:
    """Spans that ``body`` finds in the plain form of a text, with the text's own values."""
    text = as_column(text)

    def own_values(spans: Column) -> Column:
        fixed_up = F.transform(
            spans,
            lambda s: s.withField("value", F.substr(text, s["start"] + 1, s["end"] - s["start"])),
        )
        return F.when(has_rare(text), fixed_up).otherwise(spans)

    return let(let(plain_spaces(text, has_rare(text)), body), own_values)


def overlaps(a: Column, b: Column) -> Column:
    # the first two tests end it for nearly all pairs; the others keep empty spans from overlapping anything
    return (a["start"] < b["end"]) & (b["start"] < a["end"]) & (a["start"] < a["end"]) & (b["start"] < b["end"])


def overlap_groups(items: Column) -> Column:
    """Arrays of ``items`` that overlaps join, by start; ``items`` are structs whose first fields are
    ``start`` and ``end``, and hold no maps.

    A sweep along the starts: a group begins where no earlier item reaches.
    """

    def opens(block: Column, top: Column) -> Column:
        start = F.struct(top.alias("top"), F.array().cast("array<boolean>").alias("out"))
        step = lambda acc, k: F.struct(
            F.greatest(acc["top"], k["end"]).alias("top"), F.concat(acc["out"], F.array(k["start"] >= acc["top"])).alias("out")
        )
        return F.aggregate(block, start, step, lambda acc: acc["out"])

    def cut(ordered: Column) -> Column:
        flags = _scan(ordered, lambda block: F.array_max(block["end"]), lambda a, b: F.greatest(a, b), opens)
        firsts = F.filter(F.transform(flags, lambda f, i: F.when(f | (i == 0), i)), lambda i: i.isNotNull())
        upto = lambda at, n: F.coalesce(F.get(at, n + 1), F.size(ordered))
        return let(firsts, lambda at: F.transform(at, lambda i, n: F.slice(ordered, i + 1, upto(at, n) - i)))

    return let(F.array_sort(items), cut)


def claim_in_order(*groups: Column) -> Column:
    """Concatenate span arrays, dropping spans that overlap an earlier array."""
    return F.aggregate(
        F.array(*groups),
        no_spans(),
        lambda acc, group: F.when(F.size(group) == 0, acc).otherwise(
            F.concat(acc, F.filter(group, lambda s: ~F.exists(acc, lambda a: overlaps(a, s))))
        ),
    )


def greedy_cover(spans: Column, sort_key: Callable[[Column, Column], Sequence[Column]], sweep: bool = True) -> Column:
    """Take spans in key order, each if it overlaps none taken; return by start.

    ``sort_key(span, index)`` gives ascending keys; the index breaks ties, so the
    order is total and the result does not depend on the partitioning. With ``sweep`` the work
    grows with the spans and with the largest set of spans that overlaps join; without it the
    expression is smaller and the work grows with their square.
    """

    keys = []

    def by_key(rows: Column) -> Column:
        return F.transform(rows, lambda r: F.struct(*[r[k].alias(k) for k in [*keys, "i", "start", "end"]]))

    def taken(ranked: Column) -> Column:
        # flat: Spark builds an ordering anew for each comparison of structs inside structs
        return F.aggregate(
            F.array_sort(ranked),
            F.array().cast("array<struct<start:int,end:int,i:int>>"),
            lambda acc, k: F.when(F.exists(acc, lambda a: overlaps(a, k)), acc).otherwise(
                F.concat(
                    acc, F.array(F.struct(k["start"].alias("start"), k["end"].alias("end"), k["i"].alias("i")))
                )
            ),
        )

    def with_keys(s: Column, i: Column) -> Column:
        values = sort_key(s, i)
        keys[:] = [f"k{n}" for n in range(len(values))]
        place = [s["start"].alias("start"), s["end"].alias("end")]
        return F.struct(*place, i.alias("i"), *[v.alias(k) for k, v in zip(keys, values)])

    def ranked_keys(s: Column, i: Column) -> Column:
        values = [v.alias(f"k{n}") for n, v in enumerate(sort_key(s, i))]
        return F.struct(*values, i.alias("i"), s["start"].alias("start"), s["end"].alias("end"))

    def cover(all_spans: Column) -> Column:
        kept = taken(F.transform(all_spans, ranked_keys))
        if sweep:  # spans of different groups never overlap
            groups = lambda: overlap_groups(F.transform(all_spans, with_keys))
            kept = F.when(F.size(all_spans) <= _FEW, kept).otherwise(F.flatten(F.transform(groups(), lambda g: taken(by_key(g)))))
        return F.transform(F.array_sort(kept), lambda k: F.get(all_spans, k["i"]))

    return let(spans, lambda s: F.when(F.size(s) <= 1, s).otherwise(cover(s)))


def type_priority(type_: Column) -> Column:
    expr = None
    for name, score in fixed.ENTITY_PRIORITY.items():
        expr = F.when(type_ == name, score) if expr is None else expr.when(type_ == name, score)
    return expr.otherwise(fixed.OTHER_TYPE_PRIORITY)


def resolve_overlaps(spans) -> Column:
    """The non-overlapping winners, by start.

    Order: type priority, longer first, confidence in steps of 0.05, start,
    detector rank. The steps make the tolerance of 0.05 a total order.
    """
    return greedy_cover(
        as_column(spans),
        lambda s, i: (
            -type_priority(s["type"]),
            s["start"] - s["end"],
            -F.floor(s["confidence"] * 20 + 1e-9),
            s["start"],
            s["rank"],
        ),
    )


def longest_cover(spans) -> Column:
    """Winners by length, then confidence, then start (rules and names)."""
    return greedy_cover(
        as_column(spans), lambda s, i: (s["start"] - s["end"], -s["confidence"], s["start"])
    )


def merge_spans(text, spans) -> Column:
    """Join neighbours of one type with only white space between them, and overlaps."""
    text = as_column(text)

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        gap = F.substr(text, last["end"] + 1, F.greatest(s["start"] - last["end"], F.lit(0)))
        adjacent = (
            (last["type"] == s["type"])
            & (s["start"] >= last["end"])
            & F.regexp_like(gap, F.lit(f"^{SPACE}*$"))
        )

        def joined(end: Column, confidence: Column) -> Column:
            grown = F.struct(
                last["type"].alias("type"),
                F.substr(text, last["start"] + 1, end - last["start"]).alias("value"),
                last["start"].alias("start"),
                end.alias("end"),
                confidence.alias("confidence"),
                last["rank"].alias("rank"),
                last["metadata"].alias("metadata"),
            )
            return F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))

        return (
            F.when(F.size(acc) == 0, F.array(s))
            .when(adjacent, joined(s["end"], F.greatest(last["confidence"], s["confidence"])))
            .when(overlaps(last, s), joined(F.greatest(last["end"], s["end"]), last["confidence"]))
            .otherwise(F.concat(acc, F.array(s)))
        )

    ordered = F.array_sort(
        as_column(spans), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)
    )
    return F.aggregate(ordered, no_spans(), step)


def replace_spans(text, spans, replacement: Callable[[Column], Column]) -> Column:
    """Rewrite disjoint, start-ordered spans; each piece of text is copied once. A span without a
    replacement is redacted: no text is lost and no value shown."""
    text = as_column(text)

    def rewrite(items: Column) -> Column:
        pieces = F.transform(
            items,
            lambda s, i: let(
                F.when(i == 0, F.lit(0)).otherwise(F.get(items, i - 1)["end"]),
                lambda at: F.concat(F.substr(text, at + 1, s["start"] - at), F.coalesce(replacement(s), _redacted(s))),
            ),
        )
        tail = F.substr(text, F.element_at(items, -1)["end"] + 1)
        return F.concat(F.array_join(pieces, ""), tail)

    return let(
        as_column(spans),
        lambda items: F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, text).otherwise(rewrite(items)),
    )


def _redacted(span: Column) -> Column:
    return F.concat(F.lit("[REDACTED_"), F.coalesce(span["type"], F.lit("VALUE")), F.lit("]"))


def redact(text, spans) -> Column:
    """Every span becomes ``[REDACTED_<TYPE>]``."""
    return replace_spans(text, spans, _redacted)


def explode_spans(df: DataFrame, spans: str = "spans", *, keep=None) -> DataFrame:
    """One row per span, next to the columns named in ``keep`` (default: all others).

    The outer form plus a filter on the generated column keeps the optimizer from
    copying the detection into an inferred ``size(spans) > 0`` filter.
    """
    columns = keep if keep is not None else [c for c in df.columns if c != spans]
    return df.select(*columns, F.inline_outer(F.col(spans))).filter(F.col("type").isNotNull())


def type_counts(spans) -> Column:
    """``map<type, count>`` of one row's spans, keys sorted."""
    types = lambda items: F.transform(items, lambda s: s["type"])
    return let(
        types(as_column(spans)),
        lambda t: F.map_from_entries(
            F.transform(
                F.array_sort(F.array_distinct(t)),
                lambda name: F.struct(
                    name.alias("key"), F.size(F.filter(t, lambda x: x == name)).alias("value")
                ),
            )
        ),
    )
