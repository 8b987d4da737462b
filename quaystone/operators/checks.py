"""Check and gate records."""

from __future__ import annotations

import operator
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

COMPARE = {"<=": operator.le, ">=": operator.ge, "==": operator.eq}
SCHEMA = "name string, group string, severity string, observed double, threshold double, comparator string, passed boolean, detail string"


@dataclass(frozen=True)
class Check:
    name: str
    group: str
    severity: str
    observed: float
    threshold: float
    comparator: str
    detail: str = ""

    @property
    def passed(self) -> bool:
        return bool(COMPARE[self.comparator](self.observed, self.threshold))


@dataclass(frozen=True)
class Gate:
    """Two figures that must agree to ``within``."""

    name: str
    observed: float
    expected: float = 0
    detail: str = ""
    within: float = 0

    @property
    def passed(self) -> bool:
        return bool(abs(self.observed - self.expected) <= self.within)


def verdict(checks: list[Check], strict: bool = False) -> str:
    """PASS, PASS_WITH_WARNINGS or FAIL; only errors fail, unless ``strict``."""
    failed = {c.severity for c in checks if not c.passed}
    if "ERROR" in failed or (strict and failed):
        return "FAIL"
    return "PASS_WITH_WARNINGS" if failed else "PASS"


def as_table(spark: SparkSession, checks: list[Check]) -> DataFrame:
    rows = [asdict(c) | {"passed": c.passed} for c in checks]
    return spark.createDataFrame([tuple(float(r[k]) if k in ("observed", "threshold") else r[k] for k in ("name", "group", "severity", "observed", "threshold", "comparator", "passed", "detail")) for r in rows], SCHEMA)


def gates_as_table(spark: SparkSession, gates: list[Gate]) -> DataFrame:
    return spark.createDataFrame([(g.name, float(g.observed), float(g.expected), g.passed, g.detail) for g in gates], "gate string, observed double, expected double, passed boolean, detail string")
