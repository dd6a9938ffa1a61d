"""Document fingerprints by one-permutation MinHash. Built-in functions only.

1. Words (runs between ASCII white space, lower-cased) are hashed, and every run of five gives one 64-bit hash; a text of one to four
   words is one shingle. 2. The top bits of a hash are its bin; each of ``BINS`` bins keeps its least hash. One sort of the hashes together with
   a mark at the end of each bin finds all minima. 3. Optimal densification: an empty bin takes the value of the first filled bin on a probe
   sequence of its own, given by universal hashes of (bin, attempt); after ``PROBES`` misses, of the filled bin with the least hash of
   (bin, filled bin). The value is hashed with the bin that takes it, so that low bits agree by chance in each bin by itself. 4. The low ``BITS`` bits of each value are packed into longs.

The likeness of two fingerprints is their share of equal bins, corrected for the chance 2^-BITS that different values agree in the bits kept:
an estimate of the Jaccard similarity of the sets of shingles with a standard error of at most 0.024.

Everything is an expression of one row; nothing is shuffled to be fingerprinted. Equal texts have equal fingerprints.

Defined results: a null, empty or blank text has the empty fingerprint, which is like itself (1) and unlike all others (0). Texts may have any
length; time grows with n log n. ``with_next`` defines the order of rows: ascending id, rows without an id first, then by text; a
row that repeats both id and text is followed by its copy; the last row is followed by the first, a single row by itself; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.common import mix, stored

SHINGLE = 5
#: Bins of a fingerprint, low bits kept of each, bins in a long.
BINS, BITS = 512, 4
_EACH = 64 // BITS
PROBES = 16
_SHIFT = 64 - (BINS - 1).bit_length()
_TAIL = (1 << _SHIFT) - 1
_PRIME = (1 << 31) - 1
#: Bytes of text between two bounds of ``with_next``, and the most bounds (besides one for each partition) that reach the driver.
RANGE_BYTES, MOST_BOUNDS = 8 << 20, 32768


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _probe(attempt: int) -> str:
    a, c = (int(x) % (_PRIME - 1) + 1 for x in mix(np.arange(2 * attempt, 2 * attempt + 2, dtype=np.uint64) + np.uint64(77)))
    return f"cast(({a}L * j + {c}L) % {_PRIME}L % {BINS} as int)"


def fingerprint(text: str) -> Column:
    """The packed fingerprint, an array of longs, of the text that the SQL expression ``text`` gives."""
    words = f"array_remove(split(lower(coalesce({text}, '')), '[\\\\x20\\\\x09-\\\\x0D]+'), '')"
    ahead = ", ".join(f"get(h, i + {k})" for k in range(1, SHINGLE))
    shingles = f"transform(slice(h, 1, greatest(size(h) - {SHINGLE - 1}, 1)), (x, i) -> xxhash64(x, {ahead}))"
    marks = f"transform(sequence({-BINS // 2}L, {BINS // 2 - 1}L), b -> shiftleft(b, {_SHIFT}) | {_TAIL}L)"
    least = f"filter(s, (x, i) -> i = 0 OR shiftright(x, {_SHIFT}) <> shiftright(get(s, i - 1), {_SHIFT}))"
    bins = f"transform({least}, x -> if((x & {_TAIL}L) = {_TAIL}L, NULL, x))"
    probes = ", ".join(f"get(m, {_probe(t)})" for t in range(PROBES))
    rest = f"array_min(transform(filter(m, b -> b IS NOT NULL), b -> named_struct('k', xxhash64(j, shiftright(b, {_SHIFT})), 'b', b))).b"
    dense = f"transform(m, (v, j) -> coalesce(v, xxhash64(j, coalesce({probes}, {rest}))))"
    packed = (f"transform(sequence(0, {BINS // _EACH - 1}), i -> aggregate(slice(d, i * {_EACH} + 1, {_EACH}), 0L, "
              f"(a, v) -> shiftleft(a, {BITS}) | (v & {(1 << BITS) - 1}L)))")
    whole = _let(dense, "d", packed)
    whole = _let(bins, "m", whole)
    whole = _let(f"sort_array(concat({shingles}, {marks}))", "s", whole)
    whole = f"if(size(h) = 0, cast(array() as array<bigint>), {whole})"
    return F.expr(_let(f"transform({words}, w -> xxhash64(w))", "h", whole))


def as_text(packed: str) -> Column:
    """The fingerprint as hexadecimal digits, one for each bin."""
    return F.expr(f"array_join(transform({packed}, x -> lpad(hex(x), 16, '0')), '')")


def likeness(a: str, b: str) -> Column:
    """The estimated similarity, 0 to 1, of the texts behind two packed fingerprints."""
    low = sum(1 << (BITS * k) for k in range(_EACH))
    spread = " | ".join(["z", *(f"shiftright(z, {k})" for k in range(1, BITS))])
    differ = f"aggregate(zip_with({a}, {b}, (x, y) -> x ^ y), 0, (n, z) -> n + bit_count(({spread}) & {low}L))"
    chance = 2.0**-BITS
    return F.expr(f"CASE WHEN size({a}) = 0 AND size({b}) = 0 THEN 1D WHEN size({a}) = 0 OR size({b}) = 0 THEN 0D "
                  f"ELSE greatest(0D, (1D - {differ} / {BINS}D - {chance}D) / {1 - chance}D) END")


def _bounds(rows: DataFrame) -> tuple[list[tuple], list[int]]:
    """Keys that cut ``rows`` (none, id, h, text) into ranges of about as many bytes, ascending from the least key; and how many ranges each starts.

    The keys and lengths alone are sorted into ranges of partitions; where the bytes of a partition pass a multiple of the
    step, there is a bound.
    """
    order = ["none", "id", "h"]
    ranged = rows.select(*order, (F.octet_length("text") + 64).cast("bigint").alias("n")).repartitionByRange(F.desc("none"), "id", "h")
    ranged = ranged.sortWithinPartitions(F.desc("none"), "id", "h").withColumn("at", F.monotonically_increasing_id())
    placed = stored(ranged.withColumn("p", F.shiftright("at", 33)))
    step = max(RANGE_BYTES, -(-(placed.agg(F.sum("n")).first()[0] or 0) // MOST_BOUNDS))
    so_far = F.sum("n").over(Window.partitionBy("p").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    cut = placed.withColumn("b", so_far).filter(F.col("b").isNull() | (F.floor(F.col("b") / step) < F.floor((F.col("b") + F.col("n")) / step)))
    found = cut.select(*order).collect()
    keys, times = [], []
    for key in sorted((not r["none"], r["id"], r["h"]) for r in found):
        if keys and keys[-1] == key:
            times[-1] += 1
        else:
            keys.append(key)
            times.append(1)
    return keys, times


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, fp, next_text, next_fp): every row with its fingerprint and the row that follows it.

    Rows are dealt once, to ranges of the order; the first row of a range is copied to the end of the one before it. A key that
    fills several ranges (rows of one id and one text) is spread over as many parts, inside which every row is followed by its copy.
    """
    kind = docs.schema[key].dataType
    rows = docs.select(
        F.col(key).isNull().alias("none"), F.coalesce(F.col(key).cast("bigint"), F.lit(0)).alias("id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("h"))
    keys, times = _bounds(rows)
    if not keys:
        keys, times = [(False, 0, 0)], [1]
    flat = lambda values, kind: f"cast(split('{','.join(map(str, values))}', ',') as array<{kind}>)"
    bounds = f"arrays_zip({flat([int(k[0]) for k in keys], 'int')}, {flat([k[1] for k in keys], 'bigint')}, {flat([k[2] for k in keys], 'bigint')})"
    wide = max(1, int(len(keys) ** 0.5))
    heads = keys[::wide]
    tops = f"arrays_zip({flat([int(k[0]) for k in heads], 'int')}, {flat([k[1] for k in heads], 'bigint')}, {flat([k[2] for k in heads], 'bigint')})"
    own = "named_struct('0', int(NOT none), '1', id, '2', h)"
    # The range of a row is the number of the last bound that is not above it.
    rows = rows.withColumn("top", F.expr(_let(own, "k", f"size(filter({tops}, b -> b <= k))")))
    rows = rows.withColumn("range", F.expr(_let(own, "k", f"(top - 1) * {wide} + size(filter(slice({bounds}, (top - 1) * {wide} + 1, {wide}), b -> b <= k)) - 1")))
    rows = rows.withColumn("first", F.expr(f"{own} = get({bounds}, range)"))
    rows = rows.withColumn("part", F.expr(f"if(first, pmod(xxhash64(monotonically_increasing_id()), get({flat(times, 'int')}, range)), 0L)"))
    rows = rows.withColumn("fp", fingerprint("text"))
    places = F.expr(f"""if(first AND part = 0, array(named_struct('range', range, 'part', part, 'guest', false),
        named_struct('range', pmod(range - 1, {len(keys)}), 'part', 0L, 'guest', true)), array(named_struct('range', range, 'part', part, 'guest', false)))""")
    dealt = rows.select("none", "id", "h", "text", "fp", F.explode(places).alias("x")).select("none", "id", "h", "text", "fp", "x.*")
    order = Window.partitionBy("range", "part").orderBy("guest", F.desc("none"), "id", "h", "text")
    follows = F.coalesce(F.lead(F.struct("text", "fp")).over(order), F.struct("text", "fp"))
    out = dealt.withColumn("next", follows).filter(~F.col("guest"))
    return out.select(F.when(~F.col("none"), F.col("id")).cast(kind).alias(key), "text", "fp", F.col("next.text").alias("next_text"), F.col("next.fp").alias("next_fp"))
