"""Declarative rules compiled to column predicates, and findings.

A rule is a conjunction of conditions on fields; a missing field makes a condition false. Patterns are folded
once, when the rule is compiled, and all rules of a set are evaluated in one pass over the events.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.documents import read_strict
from ..functions.text import casefold, fold

OPERATORS = ("equals", "contains_any", "endswith_any")


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: object

    def compile(self, find) -> Column:
        c = find(self.field)
        if self.op == "equals":
            test = casefold(c.cast("string")) == self.value.casefold() if isinstance(self.value, str) else c == F.lit(self.value)
        elif self.op in ("contains_any", "endswith_any"):
            method = "contains" if self.op == "contains_any" else "endswith"
            test = functools.reduce(lambda a, b: a | b, [getattr(fold(c.cast("string")), method)(v.lower()) for v in self.value])
        else:
            raise ValueError(f"unknown operator {self.op}")
        return F.coalesce(test, F.lit(False))


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    severity: str
    conditions: tuple[Condition, ...]
    attack: tuple[str, ...] = ()
    rationale: str = ""
    false_positives: tuple[str, ...] = ()
    limitations: tuple[str, ...] = ()

    def predicate(self, find=None) -> Column:
        return functools.reduce(lambda a, b: a & b, [c.compile(find or event_field) for c in self.conditions])


def event_field(name: str) -> Column:
    """A top-level column, or a key of the event_data map, which may itself contain dots."""
    head, dot, key = name.partition(".")
    return F.col("event_data")[key] if dot and head == "event_data" else F.col(name)


def load_rules(text: str) -> list[Rule]:
    """Rules from a JSON list; rejects unknown operators, missing parts and repeated ids."""
    rules = []
    for r in read_strict(text):
        conditions = []
        for c in r["conditions"]:
            if c["op"] not in OPERATORS or not c["field"]:
                raise ValueError(f"rule {r['id']}: bad condition {c}")
            many = c["op"] != "equals"
            if many and not (isinstance(c["value"], list) and c["value"] and all(isinstance(v, str) and v for v in c["value"])):
                raise ValueError(f"rule {r['id']}: {c['op']} takes a list of texts")
            conditions.append(Condition(c["field"], c["op"], tuple(c["value"]) if many else c["value"]))
        if not conditions:
            raise ValueError(f"rule {r['id']} has no conditions")
        rules.append(Rule(r["id"], r["title"], r["severity"], tuple(conditions), *(tuple(r.get(k, ())) if k != "rationale" else r.get(k, "") for k in ("attack", "rationale", "false_positives", "limitations"))))
    if len({r.id for r in rules}) < len(rules):
        raise ValueError("rule ids repeat")
    return rules


def sigma_rule(document: dict) -> Rule:
    """A rule from a Sigma document (the parsed YAML): selections of fields with values, joined by "and".

    A field may have the modifier ``endswith`` or ``contains``; a list of values means any of them. Whatever can't be
    said as a conjunction (or, not, of, other modifiers) is an error.
    """
    detection = document["detection"]
    conditions = []
    for name in re.split(r" +and +", detection["condition"].strip()):
        if not isinstance(detection.get(name), dict):
            raise ValueError(f"condition is no conjunction of selections: {detection['condition']}")
        for key, value in detection[name].items():
            field, _, modifier = key.partition("|")
            values = tuple(map(str, value)) if isinstance(value, list) else (str(value),)
            if modifier not in ("", "endswith", "contains") or (not modifier and len(values) > 1):
                raise ValueError(f"unsupported field {key}")
            where = field if field in ("host", "channel", "provider", "event_id") else f"event_data.{field}"
            conditions.append(Condition(where, f"{modifier}_any", values) if modifier else Condition(where, "equals", values[0]))
    tags = tuple(t.removeprefix("attack.").upper() for t in document.get("tags", ()) if re.match(r"attack\.t\d", t))
    return Rule(document["id"], document["title"], document.get("level", "medium"), tuple(conditions), tags, document.get("description", ""), tuple(document.get("falsepositives", ())))


def finding_id(rule_id: Column, uids: Column) -> Column:
    """SHA-256 of the rule and its evidence; uids is an array of texts."""
    return F.sha2(F.concat(rule_id, F.lit(":"), F.array_join(uids, ":")), 256)


def match(df: DataFrame, rules: list[Rule], uid: str, find=None) -> DataFrame:
    """A row for each rule that a row of df meets: all of df, with rule_id, severity and finding_id."""
    hits = F.array_compact(F.array(*[F.when(r.predicate(find), F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"))) for r in rules]))
    out = df.withColumn("__hit", F.explode(hits)).select(*df.columns, "__hit.*")
    return out.withColumn("finding_id", finding_id(F.col("rule_id"), F.array(F.col(uid).cast("string"))))


def annotate(findings: DataFrame, entries: list[dict], fields: list[str], find=None) -> DataFrame:
    """findings with context_id and status: the first entry, in list order, for the rule whose fields all agree.

    Entries annotate; they never drop a finding. Only findings with one event may match.
    """
    get = find or event_field
    context = F.coalesce(
        *[
            F.when((F.col("rule_id") == e["rule_id"]) & functools.reduce(lambda a, b: a & b, [F.coalesce(casefold(get(f).cast("string")) == str(e["equals"][f]).casefold(), F.lit(False)) for f in fields]), F.lit(e["id"]))
            for e in entries
        ],
        F.lit(None).cast("string"),
    )
    single = F.size("evidence") == 1 if "evidence" in findings.columns else F.lit(True)
    context = F.when(single, context)
    return findings.withColumn("context_id", context).withColumn("status", F.when(context.isNotNull(), F.lit("context_matched")).otherwise(F.lit("needs_review")))


def counts(findings: DataFrame, *by: str) -> DataFrame:
    return findings.groupBy(*by).agg(F.count("*").alias("findings"))


def first_by_order(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).filter("__n = 1").drop("__n")


__all__ = ["Condition", "Rule", "annotate", "counts", "event_field", "finding_id", "first_by_order", "load_rules", "match"]
