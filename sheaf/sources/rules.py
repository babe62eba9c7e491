"""Compliance rule files: a JSON array of {rule_name, condition, severity, section, message}.

``condition`` is a Spark SQL predicate over the rule fields ``amount``,
``payment_mode``, ``category``, ``sub_category``, ``description`` (never
Python text to ``eval``). Rules are tiny driver-side metadata: they are
compiled into column expressions, the data never comes to the driver.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_RULES_PATH = os.path.join(os.path.dirname(__file__), "data", "compliance_rules.json")
SEVERITY_ORDER = ("critical", "warning", "info")
RULE_FIELDS = ("rule_name", "condition", "severity", "section", "message")


@dataclass(frozen=True)
class Rule:
    rule_name: str
    condition: str
    severity: str = "info"
    section: str = ""
    message: str = ""


def _severity_rank(sev: str) -> int:
    return SEVERITY_ORDER.index(sev) if sev in SEVERITY_ORDER else len(SEVERITY_ORDER)


def load_rules(path: str | None = DEFAULT_RULES_PATH) -> list[Rule]:
    """Rules ordered critical < warning < info < other (stable); missing or bad file -> []."""
    try:
        with open(path or DEFAULT_RULES_PATH, encoding="utf-8") as fh:
            raw = json.load(fh)
        rules = [Rule(**{k: str(r.get(k, "")) for k in RULE_FIELDS}) for r in raw
                 if isinstance(r, dict) and r.get("rule_name") and r.get("condition")]
    except (OSError, ValueError, TypeError):
        return []
    return sorted(rules, key=lambda r: _severity_rank(r.severity))


def read_rules_df(spark: SparkSession, path: str = DEFAULT_RULES_PATH) -> DataFrame:
    """The rule file as a DataFrame (multi-line JSON), in severity order with file position kept."""
    df = spark.read.option("multiLine", True).json(path).withColumn("file_pos", F.monotonically_increasing_id())
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), F.col("severity")),
                      F.lit(len(SEVERITY_ORDER) + 1))
    return df.orderBy(rank, "file_pos").select(*RULE_FIELDS)
