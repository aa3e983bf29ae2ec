"""Plan inspection: count scans, shuffles, reused shuffles, windows, sorts
and slow-path operators in a DataFrame's (final, adaptive) physical plan.

Used by the plan tests and by ``scripts/plan_report.py``.
"""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame

SLOW_PATH = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
             "BroadcastNestedLoopJoin", "CartesianProduct")


def plan_text(df: DataFrame, mode: str = "simple") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def plan_stats(df: DataFrame, execute: bool = True) -> dict[str, int]:
    """Operator counts; with ``execute`` the query runs first so that the
    adaptive plan is final (reused exchanges, runtime join choices)."""
    if execute:
        # The plan that is explained must be this DataFrame's own, so no writer;
        # one result partition comes to the driver, not the whole result.
        next(df.toLocalIterator(), None)
    text = plan_text(df)
    final = text.split("== Initial Plan ==")[0]
    return {
        "scans": len(re.findall(r"FileScan|Scan parquet|Scan ExistingRDD|Scan OneRowRelation", final)),
        "exchanges": len(re.findall(r"\bExchange hashpartitioning|\bExchange SinglePartition|\bExchange rangepartitioning|\bExchange RoundRobinPartitioning", final)),
        "reused_exchanges": final.count("ReusedExchange"),
        "windows": len(re.findall(r"\bWindow \[", final)),
        "sorts": len(re.findall(r"\bSort \[", final)),
        "broadcasts": final.count("BroadcastExchange"),
        "slow_path": sum(final.count(s) for s in SLOW_PATH),
    }
