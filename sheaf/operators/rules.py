"""Rule scan: every rule as one column predicate; all rules counted in one aggregation."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.rules import Rule, load_rules
from .common import drop_null_keys, resolve_by, sql_str
from .predicates import refusal


def rule_fields(df: DataFrame, cat_col: str = "Category") -> dict[str, str]:
    """Rule field name -> ledger column (absent columns are null)."""
    m = {"amount": "Amount", "payment_mode": "Payment_Mode", "category": cat_col, "sub_category": "Sub_Category",
         "description": "Description"}
    return {k: v for k, v in m.items() if v in df.columns}


def rule_match(rule: Rule, df: DataFrame, cat_col: str = "Category") -> Column:
    """The rule predicate on the ledger row; null (unknown) counts as no match.

    Rule field names are rewritten to the ledger's columns (outside string
    literals); a field whose column is absent reads as NULL, so the rule does
    not fire.
    """
    return F.coalesce(F.expr(_bind(rule.condition, rule_fields(df, cat_col))), F.lit(False))


def check_rules(df: DataFrame, rules: list[Rule], cat_col: str = "Category") -> tuple[list[Rule], list[tuple[Rule, str]]]:
    """Rules whose predicate this ledger can evaluate, and the others with their error: one bad rule never stops a scan.

    Only the plan is analysed; no row is read. A condition outside the predicate language (see ``predicates``) is an error.
    """
    good, bad = [], []
    for r in rules:
        try:
            condition = _bind(r.condition, rule_fields(df, cat_col))
            if why := refusal(df, F.expr(condition), condition):
                raise ValueError(why)
            good.append(r)
        except Exception as error:  # noqa: BLE001 - whatever the analyser says about this rule is reported
            bad.append((r, str(error).split("\n")[0]))
            warnings.warn(f"compliance rule {r.rule_name!r} is skipped: {bad[-1][1]}", stacklevel=3)
    return good, bad


def _bind(condition: str, fields: dict[str, str]) -> str:
    """Replace bare rule field names with back-quoted ledger columns (outside string literals)."""
    import re
    out, i = [], 0
    for m in re.finditer(r"'(?:[^'\\]|\\.|'')*'", condition):
        out.append(_bind_words(condition[i:m.start()], fields))
        out.append(m.group(0))
        i = m.end()
    out.append(_bind_words(condition[i:], fields))
    return "".join(out)


def _usable(df: DataFrame, rules: list[Rule] | None, cat_col: str) -> list[Rule]:
    return check_rules(df, load_rules() if rules is None else rules, cat_col)[0]


def _bind_words(text: str, fields: dict[str, str]) -> str:
    import re
    text = re.sub(r"(?i)\bcast\s*\(", "try_cast(", text)  # a value that does not convert is unknown, not an error
    return re.sub(r"\b(amount|payment_mode|category|sub_category|description)\b",
                  lambda m: f"`{fields[m.group(1)]}`" if m.group(1) in fields else "NULL", text)


def rule_violations(df: DataFrame, rules: list[Rule] | None = None, by: list[str] | None = None,
                    cat_col: str = "Category") -> DataFrame:
    """Per key and rule with at least one hit: name, severity, section, message, count, sum(Amount).

    One aggregation evaluates every rule (the reference makes one row-wise
    pass per rule); the result is unpivoted with ``stack`` and zero-hit rules
    dropped. ``rule_order`` keeps the severity order of the rule list.
    """
    rules = _usable(df, rules, cat_col)
    by = resolve_by(df, by)
    src = drop_null_keys(df, by)
    if not rules:  # nothing to evaluate: an empty result of the same shape
        return src.select(*by, F.expr("stack(1, 0, '', '', '', '', CAST(0 AS BIGINT), 0.0D) AS (rule_order, rule_name, "
                                      "severity, section, message, count, total_amount)")).filter(F.lit(False))
    aggs = []
    for i, r in enumerate(rules):
        m = rule_match(r, df, cat_col)
        aggs += [F.count_if(m).alias(f"n{i}"), F.sum(F.when(m, F.col("Amount"))).alias(f"s{i}")]
    g = src.groupBy(*by).agg(*aggs) if by else src.agg(*aggs)
    items = ", ".join(
        f"{i}, {sql_str(r.rule_name)}, {sql_str(r.severity)}, {sql_str(r.section)}, {sql_str(r.message)}, n{i}, "
        f"CAST(s{i} AS DOUBLE)" for i, r in enumerate(rules))
    long = g.selectExpr(*[f"`{b}`" for b in by],
                        f"stack({len(rules)}, {items}) AS (rule_order, rule_name, severity, section, message, "
                        f"count, total_amount)")
    return long.filter(F.col("count") > 0)


def rule_hits(df: DataFrame, rules: list[Rule] | None = None, cat_col: str = "Category",
              keep: list[str] | None = None) -> DataFrame:
    """Row-level hits: one output row per (ledger row, matching rule). Stateless, so it also streams."""
    rules = _usable(df, rules, cat_col)
    keep = keep or [c for c in ("Company_ID", "Date", "Description", "Amount", "Payment_Mode", cat_col,
                                "Sub_Category") if c in df.columns]
    none = F.array().cast("array<struct<rule_name:string,severity:string,section:string>>")
    hits = none if not rules else F.array(*[F.when(rule_match(r, df, cat_col), F.struct(F.lit(r.rule_name).alias("rule_name"),
                                                                  F.lit(r.severity).alias("severity"),
                                                                  F.lit(r.section).alias("section")))
                     for r in rules])
    return (df.select(*keep, F.array_compact(hits).alias("_h"))
            .select(*keep, F.explode("_h").alias("_r")).select(*keep, "_r.*"))
