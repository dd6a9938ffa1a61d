"""Building and checking annotated corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cloakframe.functions.spans import let, literal_spans, q, utf16_length
from cloakframe.operators import detect
from cloakframe.operators.rules import EXACT_AND_CONTEXT
from cloakframe.operators.sweep import overlap_runs, spread

# Length bands and the notice that pads long documents.
BANDS = ((100, "short"), (500, "medium"), (3000, "long"), (None, "very_long"))
PAD_TO = 3050


# --- annotation ---------------------------------------------------------------------------


def annotate_fragments(docs: DataFrame, fragments: DataFrame) -> DataFrame:
    """Every non-overlapping occurrence of each fragment of a document becomes a span.

    fragments: (doc_id, type, fragment, …). A fragment without an occurrence gives one row
    with a null start: the error row. The join is by document.
    """
    extra = [c for c in fragments.columns if c not in ("doc_id", "fragment")]
    joined = fragments.join(docs.select("doc_id", "text"), "doc_id")
    hits = joined.withColumn("h", F.explode_outer(F.expr(literal_spans("text", "fragment"))))
    return hits.select(
        "doc_id", *extra, F.col("fragment").alias("text"), F.col("h.start").alias("start"), F.col("h.end").alias("end")
    )


#: Bits of the filter of passage keys, as a power of two, and the most keys for which it is used and its keys are broadcast (8 MB).
FILTER_BITS, MOST_KEYS = 22, 1 << 20
_SHORT_PIECES = "regexp_extract_all(text, '(?s).{1,256}', 0)"


def _key_filter(keys: DataFrame) -> tuple[int, str]:
    """(number of distinct keys ``_k``, condition on a key ``k`` that every one of them meets).

    The condition reads a bitmap of fixed size; beyond ``MOST_KEYS`` keys it would let most through, and is ``true``. One job over the keys alone.
    """
    word = F.shiftrightunsigned("_k", 64 - FILTER_BITS + 6)
    rows = keys.select("_k").distinct().groupBy(word.alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_k & 63 AS int))")).alias("bits"), F.count("*").alias("n")).collect()
    n = sum(r["n"] for r in rows)
    if not 0 < n <= MOST_KEYS:
        return n, "true"
    bits = dict((r["w"], r["bits"]) for r in rows)
    flat = ",".join(str(bits.get(w, 0)) for w in range(1 << (FILTER_BITS - 6)))
    at = f"cast(shiftrightunsigned(k, {64 - FILTER_BITS + 6}) AS int)"
    return n, f"(get(cast(split('{flat}', ',') AS array<bigint>), {at}) & shiftleft(1L, cast(k & 63 AS int))) <> 0"


def _met_keys(docs: DataFrame, grams: str, keys: DataFrame, n: int, condition: str) -> DataFrame:
    """(doc_id, _k): the distinct keys of each document that some passage has. The others are dropped inside the row, or by the join right behind it."""
    mine = docs.select("doc_id", F.explode(F.expr(f"filter({grams}, k -> {condition})")).alias("_k"))
    wanted = keys.select("_k").distinct()
    return mine.join(F.broadcast(wanted) if n <= MOST_KEYS else wanted, "_k", "left_semi")


def _rarest_first(met: DataFrame, keyed: DataFrame, n: int) -> DataFrame:
    """(doc_id, pid, fragment): documents that hold the key of a passage which the fewest documents hold.

    Frequencies are counted map-side. A passage with a key that no document holds occurs nowhere.
    """
    often = met.groupBy("_k").agg(F.count("*").alias("_n"))
    seen = F.coalesce("_n", F.lit(0))
    anchors = keyed.join(often, "_k", "left").groupBy("pid", "fragment").agg(F.min(F.struct(seen.alias("n"), F.col("_k").alias("k"))).alias("a"))
    anchors = anchors.filter("a.n > 0").select("pid", "fragment", F.col("a.k").alias("_k"))
    return met.join(F.broadcast(anchors) if n <= MOST_KEYS else anchors, "_k").select("doc_id", "pid", "fragment").distinct()


def find_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """Occurrences of corpus-wide passages (pid, fragment) in documents, without comparing all pairs.

    The keys of a passage are its neighbouring inner words, which any text that holds the passage must hold as whole words too. A
    document's word pairs are held against a filter of all passages' keys before they leave the row, so no pair is exchanged that no passage
    has. A passage then meets documents by its rarest key in these documents, so a phrase that many texts share brings
    nothing together unless it is all there is. Passages without two inner words are met by their leading characters.
    """
    # Words split at single blanks; inner words have a blank on both sides inside the passage.
    inner = "slice(split(fragment, ' '), 2, greatest(size(split(fragment, ' ')) - 2, 0))"
    pairs = f"transform(sequence(1, size({inner}) - 1), i -> xxhash64(concat(get({inner}, i - 1), ' ', get({inner}, i))))"
    long = F.expr(f"size({inner}) >= 2")
    keyed = passages.filter(long).select("pid", "fragment", F.explode(F.expr(f"array_distinct({pairs})")).alias("_k"))
    words = "split(text, ' ')"
    grams = (
        f"element_at(transform(array({words}), w -> if(size(w) < 2, cast(array() AS array<bigint>), array_distinct("
        "transform(sequence(1, size(w) - 1), i -> xxhash64(concat(get(w, i - 1), ' ', get(w, i))))))), 1)"
    )
    n, condition = _key_filter(keyed)
    parts = [_rarest_first(_met_keys(docs, grams, keyed, n, condition), keyed, n)]
    lead = passages.filter(~long & (F.length("fragment") > 0)).select("pid", "fragment", F.expr("xxhash64(substring(fragment, 1, 8))").alias("_k"))
    n, condition = _key_filter(lead)
    if n:
        sizes = sorted(r[0] for r in lead.select(F.expr("least(length(fragment), 8)")).distinct().collect())  # 1 to 8
        runs = ", ".join(f"transform(sequence(1, length(p) - {len_ - 1}), i -> if(i + {len_ - 1} <= length(p), xxhash64(substring(p, i, {len_})), NULL))" for len_ in sizes)
        # A piece of the text with the first characters of the next one; runs are cut from the piece, not from the text.
        each = f"flatten(transform(ps, (x, j) -> element_at(transform(array(concat(x, substring(coalesce(get(ps, j + 1), ''), 1, 7))), p -> if(p = '', array(), concat({runs}))), 1)))"
        parts.append(_rarest_first(_met_keys(docs, f"array_distinct({let(_SHORT_PIECES, 'ps', each)})", lead, n, condition), lead, n))
    candidates = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    found = candidates.join(docs.select("doc_id", "text"), "doc_id").filter("contains(text, fragment)")
    hits = found.withColumn("h", F.explode_outer(F.expr(literal_spans("text", "fragment")))).filter("h IS NOT NULL")
    return hits.select(
        "doc_id", "pid", F.col("h.start").alias("start"), F.col("h.end").alias("end"), F.col("fragment").alias("text")
    )


def extend_documents(docs: DataFrame, spans: DataFrame, appendix: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Append a text and annotate it with the document's distinct fragments, offsets shifted."""
    longer = docs.join(appendix.select("doc_id", "appendix"), "doc_id", "left")
    grown = longer.withColumn("text", F.expr("concat(text, coalesce(appendix, ''))")).drop("appendix")
    first = spans.groupBy("doc_id", F.col("text").alias("fragment")).agg(F.min_by("type", F.struct("start", "end", "type")).alias("type"))
    base = longer.filter("appendix IS NOT NULL").select(
        "doc_id", F.col("appendix").alias("text"), F.length("text").alias("_base")
    )
    extra = annotate_fragments(base, first).filter("start IS NOT NULL")
    moved = extra.join(base.select("doc_id", "_base"), "doc_id").select(
        "doc_id", (F.col("start") + F.col("_base")).alias("start"), (F.col("end") + F.col("_base")).alias("end"), "type", "text"
    )
    return grown, spans.select("doc_id", "start", "end", "type", "text").unionByName(moved)


def pad_documents(docs: DataFrame, notice: str, target: int = PAD_TO) -> DataFrame:
    """Lengthen texts to at least ``target`` by a neutral notice; ``{n}`` in it is the length so far."""
    before, _, after = notice.partition("{n}")
    steps = f"sequence(1, cast(ceil({target} / {len(before) + len(after) + 1}) AS int) + 1)"
    add = f"concat(a, {q(before)}, length(a), {q(after)})"
    return docs.withColumn("text", F.expr(f"aggregate({steps}, text, (a, i) -> if(length(a) < {target}, {add}, a))"))


def length_band(text: str = "text") -> str:
    cases = " ".join(f"WHEN length({text}) < {n} THEN '{name}'" for n, name in BANDS if n)
    return f"CASE {cases} ELSE '{BANDS[-1][1]}' END"


def risk_group(docs: DataFrame, spans: DataFrame, semantic: DataFrame) -> DataFrame:
    """Per document: quasi_identifier, direct or none, and whether it is free of gold."""
    marks = spans.groupBy("doc_id").agg(F.bool_or(F.coalesce(F.col("context_class") == "quasi_identifier", F.lit(False))).alias("_quasi"))
    sem = semantic.select("doc_id").distinct().withColumn("_sem", F.lit(True))
    group = "CASE WHEN _quasi THEN 'quasi_identifier' WHEN _quasi IS NOT NULL OR _sem THEN 'direct' ELSE 'none' END"
    return docs.select("doc_id").join(marks, "doc_id", "left").join(sem, "doc_id", "left").select(
        "doc_id", F.expr(group).alias("risk_group"), F.col("_quasi").isNull().alias("pii_free")
    )


# --- reports and checks ----------------------------------------------------------------------


def corpus_summary(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Per language and length band: documents, gold spans, redactable spans, PII-free documents."""
    per_doc = spans.groupBy("doc_id").agg(
        F.count("*").alias("_gold"), F.count_if("should_redact").alias("_red")
    )
    return (
        docs.select("doc_id", "lang", F.expr(length_band()).alias("band"))
        .join(per_doc, "doc_id", "left")
        .groupBy("lang", "band")
        .agg(
            F.count("*").alias("docs"),
            F.coalesce(F.sum("_gold"), F.lit(0)).alias("gold"),
            F.coalesce(F.sum("_red"), F.lit(0)).alias("redactable"),
            F.count_if(F.col("_gold").isNull()).alias("pii_free"),
        )
    )


def gold_integrity(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Violations: spans out of bounds or not equal to their text, and repeated document ids."""
    texts = spread(docs.select("doc_id", F.col("text").alias("_doc")), "doc_id")
    why = (
        "CASE WHEN _doc IS NULL THEN 'unknown_document' "
        "WHEN start < 0 OR end <= start OR end > length(_doc) THEN 'out_of_bounds' "
        "WHEN substring(_doc, start + 1, end - start) <> text THEN 'text_mismatch' END"
    )
    bad = (
        spread(spans, "doc_id").join(texts, "doc_id", "left").withColumn("violation", F.expr(why)).filter("violation IS NOT NULL")
        .select("doc_id", "start", "end", "violation")
    )
    again = docs.groupBy("doc_id").agg(F.count("*").alias("_n")).filter("_n > 1")
    none = F.lit(None).cast("int")
    return bad.unionByName(
        again.select("doc_id", none.alias("start"), none.alias("end"), F.lit("duplicate_id").alias("violation"))
    )


def gold_overlaps(spans: DataFrame, allow_same_span: bool = False) -> DataFrame:
    """Spans that overlap another of their document; optionally equal spans of two types are fine."""
    distinct = spans.select("doc_id", "start", "end", "type").distinct() if allow_same_span else spans
    runs = overlap_runs(distinct.select("doc_id", "start", "end", "type"))
    size = runs.groupBy("doc_id", "run").agg(
        F.count("*").alias("_n"), F.min("start").alias("_a"), F.max("start").alias("_c"), F.min("end").alias("_d"),
        F.max("end").alias("_e"),
    )
    bad = size.filter("_n > 1")
    if allow_same_span:
        bad = bad.filter("_a <> _c OR _d <> _e")
    return runs.join(bad.select("doc_id", "run"), ["doc_id", "run"]).select("doc_id", "start", "end", "type")


def utf16_offsets(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """UTF-16 offsets of each span and whether they cut out the same text."""
    texts = docs.select("doc_id", F.col("text").alias("_doc"))
    head = lambda at: utf16_length(f"substring(_doc, 1, {at})")
    wide = spans.join(texts, "doc_id").withColumns(
        {"start_utf16": F.expr(head("start")), "end_utf16": F.expr(head("end"))}
    )
    cut = "decode(substring(encode(_doc, 'UTF-16BE'), start_utf16 * 2 + 1, (end_utf16 - start_utf16) * 2), 'UTF-16BE')"
    return wide.select(
        "doc_id", "start", "end", "start_utf16", "end_utf16", F.expr(f"{cut} = text").alias("round_trip")
    )


# Code-point ranges that stress offsets.
UNICODE_FLAGS = {
    "astral": r"[\x{10000}-\x{10FFFF}]",
    "emoji": r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}]",
    "arabic": r"[\x{0600}-\x{06FF}]",
    "combining": r"[\x{0300}-\x{036F}]",
}


def unicode_flags(docs: DataFrame) -> DataFrame:
    flags = {name: F.col("text").rlike(p) for name, p in UNICODE_FLAGS.items()}
    out = docs.withColumns(flags)
    return out.select("doc_id", *flags, F.expr(" OR ".join(flags)).alias("unicode_stress"))


def composition_gates(docs: DataFrame, spans: DataFrame, floors: dict[str, int]) -> DataFrame:
    """One row per floor: its count in the corpus and whether it is met.

    ``floors`` may name: docs, long (over 3000 characters), quasi, semantic, secret, unicode,
    or ``lang:xx``. Document flags are aggregated in one pass.
    """
    secret = "('SECRET', 'DATABASE_URI', 'PRIVATE_KEY', 'PASSWORD', 'API_TOKEN')"
    per_doc = spans.groupBy("doc_id").agg(
        F.expr(f"bool_or(type IN {secret})").alias("_secret"),
        F.expr("bool_or(context_class = 'quasi_identifier')").alias("_quasi"),
        F.expr("bool_or(layer = 'semantic')").alias("_semantic"),
    )
    joined = docs.join(per_doc, "doc_id", "left")
    any_flag = " OR ".join(f"rlike(text, '{p}')".replace("\\", "\\\\") for p in UNICODE_FLAGS.values())
    tests = {"docs": "true", "long": "length(text) > 3000", "quasi": "_quasi", "semantic": "_semantic",
             "secret": "_secret", "unicode": any_flag}
    cond = lambda name: f"lang = '{name[5:]}'" if name.startswith("lang:") else tests[name]
    row = joined.agg(*[F.count_if(F.expr(cond(n))).alias(n) for n in floors])
    items = ", ".join(f"named_struct('gate', '{n}', 'n', `{n}`, 'floor', {f}L)" for n, f in floors.items())
    return row.select(F.explode(F.expr(f"array({items})")).alias("g")).select("g.*", F.expr("g.n >= g.floor").alias("ok"))


#: Rows of a range of ``ranked``, about, and the most ranges; bounds are every ``_SAMPLED``-th value of a sample.
_PER_RANGE, _RANGES, _SAMPLED = 1 << 16, 1 << 12, 64


def ranked(docs: DataFrame, order: str = "doc_id", out: str = "rank") -> DataFrame:
    """``docs`` with their rank from 0 in the order of a column, dense over the whole table; ties in no order.

    Rows are dealt to ranges of the order and numbered inside their range; a range starts where the counts of those before it end.
    The ranges' bounds are values chosen by their hash, so a row's range follows from its value alone: counts and rows agree however
    often and with whatever partitions each of them is made. Only the number of rows reaches the driver, and only one count for each
    range is summed up in one place, so ids may be sparse or hashed.
    """
    total = docs.count()
    ranges = min(_RANGES, total // _PER_RANGE + 1)
    share = F.lit(min(1.0, _SAMPLED * ranges / max(total, 1)))
    chosen = F.shiftrightunsigned(F.xxhash64(order), 11).cast("double") / F.lit(float(1 << 53)) < share
    sample = docs.filter(chosen if ranges > 1 else F.lit(False)).agg(F.array_sort(F.collect_set(order)).alias("_all"))
    bounds = sample.select(F.expr(f"filter(_all, (x, i) -> i % {_SAMPLED} = {_SAMPLED - 1})").alias("_bounds"))
    bounds = bounds.select("_bounds", F.expr(f"filter(_bounds, (x, i) -> i % {_SAMPLED} = 0)").alias("_firsts"))

    def in_ranges(rows: DataFrame) -> DataFrame:
        up_to = lambda values: f"size(filter({values}, b -> b <= `{order}`))"
        block = F.expr(f"greatest({up_to('_firsts')} - 1, 0) * {_SAMPLED}").alias("_block")
        held = rows.crossJoin(F.broadcast(bounds)).withColumn("_block", block)
        return held.withColumn("_p", F.expr(f"_block + {up_to(f'slice(_bounds, _block + 1, {_SAMPLED})')}")).drop("_bounds", "_firsts", "_block")

    counts = in_ranges(docs.select(order)).groupBy("_p").agg(F.count("*").alias("_n"))
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = F.row_number().over(W.partitionBy("_p").orderBy(F.col(order).asc_nulls_first())) - 1
    placed = in_ranges(docs).withColumn("_i", inside)
    return placed.join(F.broadcast(starts), F.col("_p") == F.col("_q")).withColumn(out, F.col("_off") + F.col("_i")).drop("_p", "_i", "_q", "_off")


def stratified_subset(docs: DataFrame, every: int = 6, always: str | None = None) -> DataFrame:
    """Every n-th document in id order plus named hard cases, each once. The sampling rule is the feature."""
    keep = F.expr(f"_rank % {every} = 0" + (f" OR ({always})" if always else ""))
    return ranked(docs, "doc_id", "_rank").filter(keep).select(*docs.columns)


def secret_scan(docs: DataFrame, key: str = "source") -> DataFrame:
    """Credential-shaped literals per source: SECRET, DATABASE_URI and PASSWORD rules only."""
    kinds = ("SECRET", "DATABASE_URI", "PASSWORD")
    rules = [r for r in EXACT_AND_CONTEXT if r.type in kinds]
    rules = [r.__class__(**{**r.__dict__, "order": i}) for i, r in enumerate(rules)]
    found = detect.explode_spans(detect.scan(docs, rules, extraction=False), [key, "doc_id"])
    # One value found by two rules is one finding.
    spots = found.select(key, "doc_id", "start", "end", "type").distinct()
    return spots.groupBy(key, "type").agg(F.count("*").alias("findings"), F.count_distinct("doc_id").alias("docs"))
