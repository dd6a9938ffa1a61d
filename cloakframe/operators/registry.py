"""Detector slots, plug-in detectors and plug-in rules.

A detector is a function from documents to a span table; built-in ones run as array
expressions. Which detectors run is decided while the plan is built, so an unselected
one is simply not in it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.spans import q
from cloakframe.operators import detect
from cloakframe.operators.arbitrate import arbitrate
from cloakframe.operators.rules import Rule, built_in_rules
from cloakframe.schema import SPAN_COLUMNS, SPAN_T

BUILT_IN, CHINESE_IE, GENERAL_PII, SEMANTIC = "built_in", "chinese_ie", "general_pii", "semantic_privacy"
ENGINE = {BUILT_IN: "multilingual_rules", CHINESE_IE: "chinese_ie", GENERAL_PII: "general_pii", SEMANTIC: "semantic_privacy"}
NOT_READY = "optional_models_not_ready"


@dataclass(frozen=True)
class Detector:
    """A plug-in: ``run`` maps documents to a span table; ``batch`` maps texts to lists of span dicts inside the tasks.

    The registry calls ``batch`` itself, so a text on which it fails costs a warning of that document, not the job.
    """

    slot: str
    name: str
    run: Callable[[DataFrame], DataFrame] | None = None
    ready: bool = True
    batch: Callable[[list[str]], list[list[dict]]] | None = None


_FOUND = "struct<spans:array<struct<start:int,end:int,type:string,text:string,confidence:double>>,warning:string>"


def guarded(detector: Detector):
    """A column function from texts to (spans, warning) of a ``batch`` detector; a text that it fails on has no spans and a warning."""
    fields = ("start", "end", "type", "text", "confidence")

    def run(texts: pd.Series) -> pd.DataFrame:
        listed = texts.tolist()
        try:
            found = [(spans, None) for spans in detector.batch(listed)]
        except Exception:  # find the texts that fail
            found = []
            for text in listed:
                try:
                    found.append((detector.batch([text])[0], None))
                except Exception as err:
                    found.append(([], f"detector_failed:{detector.name}:{type(err).__name__}"))
        return pd.DataFrame({"spans": [[{f: s.get(f) for f in fields} for s in spans] for spans, _ in found], "warning": [w for _, w in found]})

    # Not to be copied by the optimizer: a plug-in runs once for each text.
    return F.pandas_udf(run, _FOUND).asNondeterministic()


class Registry:
    """Which detectors exist, which are enabled, and the extra rules of the built-in one."""

    def __init__(self) -> None:
        self._detectors: dict[str, Detector] = {}
        self._enabled: dict[str, bool] = {BUILT_IN: True, CHINESE_IE: True}
        self._rules: list[Rule] = list(built_in_rules())

    # -- plug-ins

    def register(self, detector: Detector, enabled: bool = False) -> None:
        """Add or replace the detector of a slot. The two built-in slots stay in place."""
        if detector.slot in (BUILT_IN, CHINESE_IE):
            raise ValueError(f"slot {detector.slot!r} is built in")
        self._detectors[detector.slot] = detector
        self._enabled.setdefault(detector.slot, enabled)

    def set_enabled(self, slot: str, enabled: bool) -> None:
        """The deterministic rules can never be switched off."""
        if slot != BUILT_IN:
            self._enabled[slot] = enabled

    def is_enabled(self, slot: str) -> bool:
        return self._enabled.get(slot, False)

    def register_rule(self, spark, rule: Rule) -> Rule:
        """Append a rule after the built-in list; its pattern must compile where it will run."""
        if any(r.key == rule.key for r in self._rules):
            raise ValueError(f"rule {rule.key!r} exists")
        try:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(rule.java)
        except Exception as err:
            raise ValueError(f"rule {rule.key!r} has no valid pattern") from err
        probe = re.sub(r"\\.|\[[^\]]*\]", "", rule.before + rule.after)
        if re.search(r"\((?!\?)", probe):
            raise ValueError("before and after may not hold capture groups")
        placed = replace(rule, order=max(r.order for r in self._rules) + 1)
        self._rules.append(placed)
        return placed

    @property
    def rules(self) -> tuple[Rule, ...]:
        return tuple(self._rules)

    # -- selection

    def active_slots(self, slots: Sequence[str] | None = None, use_model: bool = False) -> list[str]:
        """The rules always. Named slots and the flag for general PII overrule the switches; without either the switches decide."""
        if slots is not None:
            return [BUILT_IN, CHINESE_IE, *(s for s in slots if s not in (BUILT_IN, CHINESE_IE))]
        if use_model:
            return [BUILT_IN, CHINESE_IE, GENERAL_PII]
        return self.enabled_slots()

    def enabled_slots(self) -> list[str]:
        return [s for s, on in self._enabled.items() if on]

    def plan(self, slots: Sequence[str] | None = None, use_model: bool = False) -> tuple[list[Detector], list[str]]:
        """The plug-in detectors to run, and warnings about requested ones that cannot."""
        active = self.active_slots(slots, use_model)
        optional = [s for s in active if s in (GENERAL_PII, SEMANTIC)]
        run = [self._detectors[s] for s in active if s in self._detectors and self._detectors[s].ready]
        missing = optional and not any(d.slot in (GENERAL_PII, SEMANTIC) for d in run)
        return run, [NOT_READY] if missing else []


def _texts(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _plugged(out: DataFrame, docs: DataFrame, plugins: Sequence[Detector]) -> tuple[DataFrame, dict[Detector, tuple[Column, Column, Column, list[str]]]]:
    """``out`` plus a column of each plug-in, and for each its spans, engines and warnings, and the warning if its plan cannot be built."""
    none, told = F.array().cast(f"array<{SPAN_T}>"), {}
    for k, d in enumerate(plugins):
        name = q(d.name)
        if d.batch:
            out = out.withColumn(f"_p{k}", guarded(d)("text"))
            made = ", ".join(f"'{c}', {v}" for c, v in {
                **{c: f"x.{c}" for c in SPAN_COLUMNS}, "confidence": "coalesce(x.confidence, 1D)", "sources": f"array({name})", "validated": "false",
                "privacy_level": "cast(NULL AS string)", "semantic_type": "cast(NULL AS string)", "ord": "5000"}.items())
            told[d] = (
                F.expr(f"cast(transform(_p{k}.spans, x -> named_struct({made})) AS array<{SPAN_T}>)"),
                F.expr(f"if(_p{k}.warning IS NULL, array({name}), array())"), F.expr(f"if(_p{k}.warning IS NULL, array(), array(_p{k}.warning))"), [])
            continue
        try:
            rows = d.run(docs).select("doc_id", F.struct(*SPAN_COLUMNS).cast(SPAN_T).alias("_s"))
        except Exception as err:  # a plug-in whose plan cannot be built must not lose the documents
            told[d] = (none, _texts([]), _texts([]), [f"detector_failed:{d.name}:{type(err).__name__}"])
            continue
        out = out.join(rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("_s")).alias(f"_p{k}")), "doc_id", "left")
        told[d] = (F.coalesce(f"_p{k}", none), _texts([d.name]), _texts([]), [])
    return out, told


def _side_by_side(spans: Sequence[Column], extraction: bool, warnings: Sequence[str], told: Sequence[tuple]) -> list[Column]:
    """The columns ``spans``, ``engines`` and ``warnings`` from those of the built-in detectors and of the plug-ins."""
    engines = _texts([ENGINE[BUILT_IN], *([ENGINE[CHINESE_IE]] if extraction else [])])
    early = _texts([*warnings, *(w for t in told for w in t[3])])
    return [F.concat(*spans, *(t[0] for t in told)).alias("spans"), F.concat(engines, *(t[1] for t in told)).alias("engines"),
            F.concat(early, *(t[2] for t in told)).alias("warnings")]


def detected(docs: DataFrame, registry: Registry, slots: Sequence[str] | None = None, use_model: bool = False) -> DataFrame:
    """``docs`` plus ``spans`` (raw spans of all active detectors on the original text), ``engines`` and ``warnings`` of each document.

    One pass: a ``batch`` plug-in sees each text once and gives spans and warning together, inside the row. A plug-in that maps
    tables is joined by document. An engine is listed for the documents it did not fail on; a plug-in whose plan cannot
    be built costs a warning everywhere, not the job. Built-in spans come first in tie order.
    """
    plugins, warnings = registry.plan(slots, use_model)
    extraction = CHINESE_IE in registry.active_slots(slots, use_model)
    out, told = _plugged(detect.scan(docs, registry.rules, extraction=extraction), docs, plugins)
    kept = [c for c in docs.columns if c not in ("spans", "engines", "warnings")]
    return out.select(*kept, *_side_by_side([F.col("spans")], extraction, warnings, [told[d] for d in plugins]))


def detected_each(docs: DataFrame, states: dict[str, tuple[Registry, Sequence[str] | None]]) -> DataFrame:
    """``detected`` for each of ``states`` (name -> registry and slots), named by the column ``state``.

    One pass for all of them: a rule list, the extraction and a plug-in that several states share run once for each document.
    """
    plans = {name: (reg.rules, CHINESE_IE in reg.active_slots(slots), *reg.plan(slots)) for name, (reg, slots) in states.items()}
    lists = list(dict.fromkeys(rules for rules, *_ in plans.values()))
    out = docs
    for k, rules in enumerate(lists):
        out = detect.scan(out, rules, extraction=False, out=f"_r{k}")
    if any(extraction for _, extraction, *_ in plans.values()):
        out = detect.scan(out, [], extraction=True, out="_x")
    out, told = _plugged(out, docs, list(dict.fromkeys(d for *_, plugins, _ in plans.values() for d in plugins)))
    each = [
        F.struct(F.lit(name).alias("state"), *_side_by_side(
            [F.col(f"_r{lists.index(rules)}"), *([F.col("_x")] if extraction else [])], extraction, warnings, [told[d] for d in plugins]))
        for name, (rules, extraction, plugins, warnings) in plans.items()
    ]
    kept = [c for c in docs.columns if c not in ("state", "spans", "engines", "warnings")]
    return out.select(*kept, F.explode(F.array(*each)).alias("_e")).select(*kept, "_e.*")


def combine_detectors(
    docs: DataFrame, registry: Registry, slots: Sequence[str] | None = None, use_model: bool = False
) -> DataFrame:
    """(doc_id, span columns, engines, warnings): the table form of ``detected``, one row per raw span."""
    return detect.explode_spans(detected(docs, registry, slots, use_model), ["doc_id", "engines", "warnings"])


def detect_documents(
    docs: DataFrame,
    registry: Registry,
    slots: Sequence[str] | None = None,
    use_model: bool = False,
    policy: str | None = None,
) -> DataFrame:
    """The whole detection: detectors, merge, level, policy; one row per span. All in the row, unless a plug-in maps tables."""
    return detect.explode_spans(arbitrate(detected(docs, registry, slots, use_model), policy))
