"""Chat records of many layouts into canonical turns and one training text. Built-in functions only.

A record is JSON. Its fingerprint is a hash of its nested field paths (names and nesting, not the types of leaves),
and the fingerprint selects a declarative mapping: paths to the turns, or one path and role per turn. Missing
optional fields are other paths, so a mapping lists the layouts it serves. A record whose fingerprint no mapping
knows has no turns and layout null; callers see it by ``layout IS NULL``.

Template: each turn is ``### role: text</turn>`` and a line feed. Inside role and text a backslash is written ``\\s``,
a ``#`` that starts ``###`` is ``\\h``, the ``<`` of ``</turn>`` is ``\\l``, and a colon in a role is ``\\c``; so no text can
forge a mark, and reading back gives the very text.

Defined results: null role or text is an empty one; an empty text is a turn; turns with one position are ordered by role and
text; repeated rows are repeated turns; empty tables give no rows. Rows of one conversation are joined in two
steps (runs of positions, then runs), since its text is one value in the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>\n"
#: Positions in a run of the first joining step.
RUN = 64

#: name -> (example record of each layout, turns). Turns are either ("list", path, role path, text path)
#: or ("fields", ((path, role), …)).
MAPPINGS: dict[str, tuple[tuple[str, ...], tuple]] = {
    "row": (('{"role":"r","text":"t"}', '{"text":"t"}', '{"role":"r"}', '{"role":"r","content":"t"}', '{}'),
            ("one", ("role",), ("text", "content"))),
    "messages": (('{"messages":[{"role":"r","content":"t"}]}', '{"messages":[{"role":"r","text":"t"}]}'),
                 ("list", "messages", ("role",), ("content", "text"))),
    "conversations": (('{"conversations":[{"from":"r","value":"t"}]}',), ("list", "conversations", ("from",), ("value",))),
    "prompt": (('{"prompt":"p","completion":"c"}', '{"prompt":"p","response":"c"}'),
               ("fields", ((("prompt",), "user"), (("completion", "response"), "assistant")))),
    "prompt_system": (('{"system":"s","prompt":"p","response":"c"}', '{"system":"s","prompt":"p","completion":"c"}'),
                      ("fields", ((("system",), "system"), (("prompt",), "user"), (("completion", "response"), "assistant")))),
    "instruction": (('{"instruction":"i","output":"o"}',), ("fields", ((("instruction",), "user"), (("output",), "assistant")))),
    "instruction_input": (('{"instruction":"i","input":"x","output":"o"}',),
                          ("fields", ((("instruction",), "user"), (("input",), "user"), (("output",), "assistant")))),
    "question": (('{"data":{"question":"q","answer":"a"}}',),
                 ("fields", ((("data.question",), "user"), (("data.answer",), "assistant")))),
}
#: Other names of roles; fixed values.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(variant: Column) -> Column:
    """The names and nesting of a record, in order of names, without the types of its leaves."""
    shape = F.schema_of_variant(variant)
    return F.regexp_replace(shape, r"(: |<)(?:VOID|STRING|BOOLEAN|BIGINT|DOUBLE|FLOAT|DATE|BINARY|UUID|VARIANT|TIMESTAMP(?:_NTZ)?|DECIMAL\(\d+,\d+\))(?=[,>])", "$1_")


def fingerprint(variant: Column) -> Column:
    return F.xxhash64(field_paths(variant))


def _text(variant: Column, paths: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.try_variant_get(variant, f"$.{p}", "string") for p in paths], F.lit(""))


def _turns(rule: tuple, v: Column) -> Column:
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    if rule[0] == "one":
        return F.array(turn(_text(v, rule[1]), _text(v, rule[2])))
    if rule[0] == "fields":
        return F.array(*[turn(F.lit(role), _text(v, paths)) for paths, role in rule[1]])
    items = F.try_variant_get(v, f"$.{rule[1]}", "array<variant>")
    return F.transform(items, lambda x: turn(_text(x, rule[2]), _text(x, rule[3])))


def canonical_turns(records: DataFrame, record: str = "record", mappings=MAPPINGS) -> DataFrame:
    """``records`` plus ``layout`` (the mapping's name or null) and ``turns``, array<struct<role, text>>."""
    v = F.col("__v")
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for name, (examples, rule) in mappings.items():
        known = F.lit(False)
        for example in examples:
            known = known | (F.col("__f") == fingerprint(F.parse_json(F.lit(example))))
        layout, turns = F.when(known, name).otherwise(layout), F.when(known, _turns(rule, v)).otherwise(turns)
    out = records.drop("layout", "turns").withColumn("__v", F.try_parse_json(record)).withColumn("__f", fingerprint(v))
    out = out.withColumn("layout", layout).withColumn("turns", turns).drop("__v", "__f")
    role = lambda r: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), r), r)
    named = F.transform("turns", lambda t: F.struct(role(t["role"]).alias("role"), t["text"].alias("text")))
    return out.withColumn("turns", F.when(F.col("layout") == "conversations", named).otherwise(F.col("turns")))


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\s"))
    return F.replace(F.regexp_replace(out, "#(?=##)", r"\\h"), F.lit("</turn>"), F.lit("\\l/turn>"))


def unescape(text: Column) -> Column:
    for code, mark in (("\\h", "#"), ("\\l", "<"), ("\\c", ":"), ("\\s", "\\")):
        text = F.replace(text, F.lit(code), F.lit(mark))
    return text


def format_turns(turns: DataFrame, conv: str = "conv_id", position: str = "turn", role: str = "role", text: str = "text",
                 learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``formatted`` and ``loss_runs``, for each turn (start, length) of the learnt characters inside it.

    Lengths are code points of the formatted text; a turn without loss has length -1.
    """
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    head = F.concat(F.lit("### "), F.replace(escape(r), F.lit(":"), F.lit("\\c")), F.lit(": "))
    piece = F.concat(head, escape(t), F.lit(END))
    run = F.struct(F.length(head).alias("start"), F.when(r.isin(*learn), F.length(escape(t))).otherwise(-1).alias("length"))
    rows = turns.select(F.col(conv), F.floor(F.col(position) / RUN).alias("run"), F.struct(
        F.col(position).alias("p"), r.alias("r"), t.alias("t"), piece.alias("piece"), run.alias("loss")).alias("x"))
    runs = rows.groupBy(conv, "run").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    runs = runs.select(conv, F.struct("run", F.array_join("xs.piece", "").alias("piece"), F.col("xs.loss").alias("loss")).alias("y"))
    whole = runs.groupBy(conv).agg(F.array_sort(F.collect_list("y"), lambda a, b: (
        F.when(a["run"].isNull() & b["run"].isNull(), 0).when(a["run"].isNull(), -1).when(b["run"].isNull(), 1)
        .when(a["run"] < b["run"], -1).when(a["run"] > b["run"], 1).otherwise(0))).alias("ys"))
    return whole.select(conv, F.array_join("ys.piece", "").alias("formatted"), F.flatten("ys.loss").alias("loss_runs"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` plus ``turns`` and ``learnt`` (text under the loss mask), both read from the text alone and its mask."""
    pieces = F.slice(F.split("formatted", END), 1, F.size(F.split("formatted", END)) - 1)
    at = lambda p: F.instr(p, ": ")
    turn = lambda p: F.struct(
        unescape(p.substr(F.lit(5), at(p) - 5)).alias("role"), unescape(p.substr(at(p) + 2, F.length(p))).alias("text"))
    taken = lambda p, m: F.when(m["length"] >= 0, unescape(p.substr(m["start"] + 1, m["length"]))).otherwise("")
    out = formatted.withColumn("__p", pieces)
    out = out.withColumn("turns", F.transform("__p", turn))
    return out.withColumn("learnt", F.array_join(F.zip_with("__p", "loss_runs", taken), "")).drop("__p")
