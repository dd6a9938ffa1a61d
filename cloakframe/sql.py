"""Functions for ``spark.sql``: scan, mask and restore as SQL-defined functions, plug-in detectors as table functions.

The SQL-defined functions hold the same expressions that the DataFrame operators use, so a query through SQL is planned and
run like one through Python: inside the row, without a UDF. A plug-in takes a table argument and runs where the table lies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from cloakframe.functions.spans import q
from cloakframe.operators import detect, mask
from cloakframe.operators.arbitrate import level_array, merge_array, policy_array
from cloakframe.operators.registry import CHINESE_IE, Registry
from cloakframe.schema import SPAN_T

VAULT_T = "array<struct<token:string,value:string,type:string,label:string>>"
MASKED_T = f"struct<status:string,masked:string,vault:{VAULT_T}>"
RESTORED_T = "struct<restored:string,replaced:int,missing:array<string>,unknown:array<string>>"


def _bodies(registry: Registry, extraction: bool, policy: str | None) -> list[tuple[str, str, str, str]]:
    """(name, parameters, result, body) of the scalar functions, in the order of their creation.

    Each step is a function of its own: a parameter stands for a value that is computed once, and a body is analysed by itself.
    """
    spans, items = f"array<{SPAN_T}>", mask.ITEM_T
    ok = f"st = '{mask.OK}'"
    made = f"named_struct('status', st, 'masked', if({ok}, {mask.mask_array('text', 'it')}, NULL), 'vault', if({ok}, {mask.vault_array('it')}, cast(array() AS {VAULT_T})))"
    unknown = f"regexp_extract_all(got.out, {q(mask.UNKNOWN)}, 0)"
    told = f"named_struct('restored', got.out, 'replaced', got.replaced, 'missing', got.missing, 'unknown', {unknown})"
    return [
        ("pii_raw", "text STRING", spans, detect.scan_sql("text", registry.rules, extraction)),
        ("pii_merged", f"raw {spans}", spans, merge_array("raw")),
        ("pii_levelled", f"won {spans}", spans, policy_array(level_array("won"), policy)),
        ("pii_spans", "text STRING", spans, "pii_levelled(pii_merged(pii_raw(text)))"),
        ("pii_items", f"sp {spans}", items, mask.items_array("sp")),
        ("pii_status", f"text STRING, it {items}", "STRING", mask.status_array("text", "it")),
        ("pii_judged", f"text STRING, it {items}, st STRING", MASKED_T, f"cast({made} AS {MASKED_T})"),
        ("pii_masked", f"text STRING, it {items}", MASKED_T, "pii_judged(text, it, pii_status(text, it))"),
        ("pii_mask", "text STRING", MASKED_T, "pii_masked(text, pii_items(pii_spans(text)))"),
        ("pii_placed", f"reply STRING, vault {VAULT_T}", mask._RESTORED, mask.restore_array("reply", "vault")),
        ("pii_told", f"got {mask._RESTORED}", RESTORED_T, f"cast({told} AS {RESTORED_T})"),
        ("pii_restore", f"reply STRING, vault {VAULT_T}", RESTORED_T, "pii_told(pii_placed(reply, vault))"),
    ]


def register_functions(
    spark: SparkSession, registry: Registry | None = None, slots: Sequence[str] | None = None, policy: str | None = None
) -> list[str]:
    """Create the session's functions and return the names of those to call.

    ``pii_spans(text)``: the final spans of a text. ``pii_scan(text)``: the same as a table, for ``LATERAL``. ``pii_mask(text)``: status,
    masked text and vault. ``pii_restore(reply, vault)``: the restored reply with its counts. ``pii_<slot>(TABLE(…))``: the spans
    of a ``batch`` plug-in for the columns ``doc_id`` and ``text`` of any table, and its warnings.
    """
    reg = registry or Registry()
    for name, parameters, result, body in _bodies(reg, CHINESE_IE in reg.active_slots(slots), policy):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    columns = "start INT, `end` INT, type STRING, text STRING, confidence DOUBLE, validated BOOLEAN, privacy_level STRING"
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION pii_scan(body STRING) RETURNS TABLE({columns}) RETURN "
        "SELECT s.start, s.`end`, s.type, s.text, s.confidence, s.validated, s.privacy_level "
        "FROM (SELECT explode_outer(found) AS s FROM (SELECT pii_spans(body) AS found) f) t WHERE s IS NOT NULL")  # a plain explode would scan again in its filters
    names = ["pii_spans", "pii_scan", "pii_mask", "pii_restore"]
    for detector in reg.plan(slots)[0]:
        if detector.batch:
            names.append(f"pii_{detector.slot}")
            spark.udtf.register(names[-1], _plug_in(detector))
    return names


def _plug_in(detector):
    """A table function over rows with ``doc_id`` and ``text``; a text that the plug-in fails on gives one row with the warning."""
    batch, name = detector.batch, detector.name

    @udtf(returnType="doc_id bigint, `start` int, `end` int, type string, text string, confidence double, warning string")
    class PlugIn:
        def eval(self, row):
            try:
                found = batch([row["text"]])[0]
            except Exception as err:
                yield row["doc_id"], None, None, None, None, None, f"detector_failed:{name}:{type(err).__name__}"
                return
            for s in found:
                yield row["doc_id"], s.get("start"), s.get("end"), s.get("type"), s.get("text"), s.get("confidence", 1.0), None

    return PlugIn
