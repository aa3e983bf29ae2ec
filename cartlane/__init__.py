"""cartlane: checkout clickstream analytics as Spark DataFrame operators.

Every public operator takes and returns a ``pyspark.sql.DataFrame`` and is
built from Catalyst-native expressions only (no Python UDFs), so the whole
plan stays inside whole-stage codegen and scales with the event table.

Layout
------
``sources``    raw-events schema and readers, the fixture adapter, sinks
``functions``  Column helpers: exact rounding, money, labels, step counters
``operators``  the analysis operators (facts, durations, funnels, sequences,
               churn, clean path, friction, revenue, population)
``plans``      query catalog (name -> DataFrame builder), DuckDB oracle SQL,
               plan-inspection helpers
``llm``        operators of a training-data pipeline (separable)
"""

from cartlane.config import CheckoutSpec, FunnelSpec, SegmentSpec, DEFAULTS

__all__ = ["CheckoutSpec", "FunnelSpec", "SegmentSpec", "DEFAULTS"]
