"""User rules that are Python code instead of Columns, beside the Column rules and in SQL.

A code rule gets one statement text without comments and returns its findings. It runs on distinct texts,
in Arrow batches of the same pass as the Column rules, so its work follows the number of texts. A rule that raises
on a text loses its findings of that text and nothing else; such failures can be asked for as rows of their own.
Code rules see whole texts as they are; null and blank texts reach no rule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workloom.functions import lexical as lx
from workloom.operators.detectors import FINDING, detect, distinct_texts, with_context

FAILED = "failed"
#: The struct that Column rules give, with the rule's names in front.
ITEM = FINDING.replace("struct<", "struct<rule_key:string,rule_id:string,", 1)
ARROW = pa.list_(pa.struct([
    ("rule_key", pa.string()), ("rule_id", pa.string()), ("severity", pa.string()), ("message", pa.string()),
    ("context", pa.map_(pa.string(), pa.string())), ("fix", pa.string())]))


class Found(NamedTuple):
    severity: str
    message: str
    fix: str | None = None
    context: dict[str, str] | None = None


class CodeRule(NamedTuple):
    key: str
    rule_id: str
    check: Callable[[str], Iterable[Found]]


def _findings(rules: Sequence[CodeRule], text: str) -> Iterator[dict]:
    """Findings of all rules on one text; a failing rule has one of severity ``failed`` instead of its own."""
    for rule in rules:
        names = {"rule_key": rule.key, "rule_id": rule.rule_id}
        try:
            own = [names | {
                "severity": f.severity, "message": f.message, "context": list((f.context or {}).items()), "fix": f.fix,
            } for f in rule.check(text)]
        except Exception as e:  # user code may raise anything; the other rules go on
            own = [names | {"severity": FAILED, "message": f"{type(e).__name__}: {e}", "context": [], "fix": None}]
        yield from own


def findings_column(rules: Sequence[CodeRule], text: Column) -> Column:
    """The findings of code rules on a text column, as an array shaped like those of Column rules."""
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else list(_findings(rules, t)) for t in texts.to_pylist()], ARROW)

    return F.coalesce(F.arrow_udf(run, f"array<{ITEM}>")(text), F.array().cast(f"array<{ITEM}>"))


def detect_mixed(statements: DataFrame, rules: Sequence[CodeRule], keys=None, failures: bool = False,
                 **context: DataFrame) -> DataFrame:
    """Findings of Column rules (``keys``) and code rules per statement; ordinals of code rules come last.
    With ``failures`` the texts on which a rule raised have a row of severity ``failed``."""
    texts = with_context(distinct_texts(statements), **context)
    found = detect(texts, keys, findings_column(rules, F.col("statement_text")))
    if not failures:
        found = found.filter(~F.col("severity").eqNullSafe(FAILED))
    runs = statements.select("statement_id", "executed_by", lx.text_key(F.col("statement_text")).alias("_digest"))
    own = found.withColumn("_digest", F.sha2("statement_text", 256)).drop("statement_text", "query_hash")
    return runs.join(own, "_digest").drop("_digest")


def register_sql(spark: SparkSession, rules: Sequence[CodeRule], name: str = "code_findings") -> None:
    """Make code rules a table function: ``SELECT … FROM t, LATERAL code_findings(t.statement_text) f``.
    A null text has no rows."""
    kept = tuple(rules)

    class Findings:
        def eval(self, text: str):
            for f in _findings(kept, text) if text is not None else ():
                yield f["rule_key"], f["rule_id"], f["severity"], f["message"], f["fix"]

    columns = "rule_key string, rule_id string, severity string, message string, fix string"
    spark.udtf.register(name, F.udtf(Findings, returnType=columns, useArrow=True))


def nesting(limit: int) -> CodeRule:
    """Parentheses nested deeper than ``limit``, outside of literals."""
    def check(text: str) -> list[Found]:
        depth = deepest = 0
        quote = None
        for c in text:
            if quote:
                quote = None if c == quote else quote
            elif c in "'\"`":
                quote = c
            elif c == "(":
                depth += 1
                deepest = max(deepest, depth)
            elif c == ")":
                depth -= 1
        if deepest <= limit:
            return []
        return [Found("medium", f"parentheses {deepest} deep", "Name the inner parts as CTEs", {"depth": str(deepest)})]

    return CodeRule("DEEP_NESTING", "CODE_001", check)
