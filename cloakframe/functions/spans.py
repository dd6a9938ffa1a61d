"""Regex matches with code-point offsets, as array expressions without a UDF.

A match is fenced by two control characters with ``regexp_replace``; splitting on
the opening one yields the pieces, and their lengths are the offsets. The two
characters cannot occur in the text: the intake step turns them into blanks.

Expressions are written as Spark SQL text: the rule list is long, and one parsed
string per rule keeps building the plan cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "\u0001", "\u0002"
BARE_T = "array<struct<start:int,end:int,text:string>>"


def q(value: str) -> str:
    """A Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def clean_text(text: Column) -> Column:
    """Replace the two fence characters by blanks (length is kept)."""
    return F.replace(F.replace(text, F.lit(OPEN), F.lit(" ")), F.lit(CLOSE), F.lit(" "))


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


_RUN = 256


def running(values: str, join: str, zero: str = "0") -> str:
    """The running fold of an array of ints: element i joins the first i values. ``join`` is SQL over ``ra`` and ``rx``.

    Folds run inside blocks of fixed size, then over the blocks, so no array that grows with the text is copied at each step.
    """
    fold = lambda arr, start: (
        f"aggregate({arr}, named_struct('p', cast({start} AS int), 'o', cast(array() AS array<int>)), "
        f"(rs, rx) -> {let('rs.p', 'ra', f"named_struct('p', cast({join} AS int), 'o', array_append(rs.o, cast({join} AS int)))")}, rs -> rs.o)"
    )
    whole = f"aggregate(rb, cast({zero} AS int), (ra, rx) -> cast({join} AS int))"
    blocks = (
        f"transform(sequence(0, cast(greatest(size(rv) - 1, 0) div {_RUN} AS int)), rk -> slice(rv, rk * {_RUN} + 1, {_RUN}))"
    )
    inner = fold("rb", f"if(ri = 0, {zero}, element_at(rp, greatest(ri, 1)))")
    total = fold(f"transform(rw, rb -> {whole})", zero)
    long = let(blocks, "rw", let(total, "rp", f"flatten(transform(rw, (rb, ri) -> {inner}))"))
    return let(values, "rv", f"if(size(rv) <= {_RUN}, {fold('rv', zero)}, {long})")


def all_differ(array: str, key: str) -> str:
    """Whether ``key`` (SQL over ``ax``, a number or a string) differs for all elements; time grows with their number only."""
    return f"size(array_distinct(transform({array}, ax -> {key}))) = size({array})"


def grouped(ordered: str, differs: str, element: str) -> str:
    """Runs of neighbours of an ``array<element>`` that belong together; ``differs`` is SQL over neighbours ``gl`` and ``gr``."""
    apart = let("element_at(ga, gi - 1)", "gl", let("element_at(ga, gi)", "gr", differs))
    first = f"filter(sequence(1, size(ga)), gi -> if(gi = 1, true, {apart}))"
    cut = "transform(gf, (gp, gk) -> slice(ga, gp, if(gk + 1 < size(gf), element_at(gf, gk + 2), size(ga) + 1) - gp))"
    return let(ordered, "ga", f"if(size(ga) = 0, cast(array() AS array<array<{element}>>), {let(first, 'gf', cut)})")


#: Code points in a piece of a long text that is cut at many places.
_PIECE = 4096


def pieces(text: str) -> str:
    """A text in pieces of fixed length, so that cutting it at many places reads each place's piece, not the text up to it."""
    return f"regexp_extract_all({text}, '(?s).{{1,{_PIECE}}}', 0)"


def cut(pieces_: str, start: str, end: str) -> str:
    """The code points from ``start`` up to ``end`` of a text in pieces."""
    first = f"cast({start} div {_PIECE} AS int)"
    last = f"cast(({end} - 1) div {_PIECE} AS int)"
    return (
        f"if({end} <= {start}, '', substring(array_join(slice({pieces_}, {first} + 1, {last} - {first} + 1), ''), "
        f"{start} % {_PIECE} + 1, {end} - {start}))"
    )


def fenced_spans(fenced: str) -> str:
    """Array of (start, end, text) from a text whose matches are fenced."""
    value = f"substring_index(fx, '{CLOSE}', 1)"
    # Piece i starts at the length of all before it, less one closing mark for each piece but the first.
    ends = running("transform(fp, (fx, fi) -> length(fx) - if(fi = 0, 0, 1))", "ra + rx")
    span = f"{let(value, 'fv', "named_struct('start', element_at(fe, fi + 1), 'end', element_at(fe, fi + 1) + length(fv), 'text', fv)")}"
    body = f"transform(slice(fp, 2, size(fp)), (fx, fi) -> {span})"
    return let(f"split({fenced}, '{OPEN}')", "fp", f"if(size(fp) < 2, cast(array() AS {BARE_T}), {let(ends, 'fe', body)})")


def fence(text: str, before: str, value: str, after: str = "", flags: str = "dU") -> str:
    """The text with the value of every match of ``before value after`` fenced.

    ``before`` and ``after`` hold no capture groups of their own. Groups inside
    ``value`` are numbered from 3, and ``after`` is a named group.
    """
    pattern = f"(?{flags})({before})({value})(?<tail>{after})"
    return f"regexp_replace({text}, {q(pattern)}, '$1{OPEN}$2{CLOSE}${{tail}}')"


def regex_spans(text: str, before: str, value: str, after: str = "", flags: str = "dU") -> str:
    """All leftmost non-overlapping matches of ``before value after``; the span is ``value``."""
    return fenced_spans(fence(text, before, value, after, flags))


def literal_spans(text: str, fragment: str) -> str:
    """Every non-overlapping occurrence of a literal, left to right."""
    fenced = f"replace({text}, {fragment}, concat('{OPEN}', {fragment}, '{CLOSE}'))"
    return f"if(length({fragment}) > 0, {fenced_spans(fenced)}, cast(array() AS {BARE_T}))"


def overlapping_starts(text: str, fragment: str) -> str:
    """Start offsets of every occurrence of a literal, overlapping ones included."""
    quoted = f"concat('(?s)(?=\\\\Q', replace({fragment}, '\\\\E', '\\\\E\\\\\\\\E\\\\Q'), '\\\\E)')"
    ends = running("transform(fp, fx -> length(fx))", "ra + rx")
    return let(f"split(regexp_replace({text}, {quoted}, '{OPEN}'), '{OPEN}')", "fp", f"slice({ends}, 1, size(fp) - 1)")


def utf16_length(s: str) -> str:
    """Length in UTF-16 code units: one more for each character beyond U+FFFF."""
    return f"(length({s}) + length(regexp_replace({s}, '[^\\\\x{{10000}}-\\\\x{{10FFFF}}]', '')))"


def once(df: DataFrame, **columns: str) -> DataFrame:
    """Add or replace columns whose (costly) expressions run exactly once per row.

    They pass through a one-row ``explode_outer``. Filters on the new columns are not pushed
    below it, where the optimizer would copy the expression into the filter and, over
    several such steps, multiply it.
    """
    fields = ", ".join(f"{q(name)}, {sql}" for name, sql in columns.items())
    kept = [c for c in df.columns if c not in columns]
    staged = df.select(*df.columns, F.explode_outer(F.expr(f"array(named_struct({fields}))")).alias("_once"))
    return staged.select(*kept, *[F.col(f"_once.{name}").alias(name) for name in columns])
