"""Adapter from the driver's generic ``events`` table to ``raw_events``.

The driver fixture has five event types, no browser, page or checkout step,
and every user purchases. Each source row is therefore expanded into a short
journey taken from a fixed template, keyed by ``event_type`` and a per-row
variant ``k`` (from the JSON ``props``). The expansion is a narrow
``inline(filter(...))`` generator: no join, no shuffle, and the template is a
literal inside the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


# --- fixed values: journey template (event_type, kmin, kmax, step, off_s,
# event_name, page_title); the same table is used by the DuckDB oracle. -----
JOURNEY_TEMPLATE = (
    ("view", 0, 99, 1, 0, "session_start", None),
    ("view", 0, 99, 2, 0, "page_view", "Home"),
    ("view", 0, 49, 3, 25, "view_item", None),
    ("view", 50, 64, 4, 60, "page_view", "Shopping Cart"),
    ("signup", 0, 99, 1, 0, "first_visit", None),
    ("signup", 0, 99, 2, 0, "session_start", None),
    ("signup", 0, 59, 3, 40, "add_to_cart", None),
    ("signup", 0, 29, 4, 70, "page_view", "Shopping Cart"),
    ("signup", 0, 99, 5, 75, "scroll", None),
    ("click", 0, 99, 1, 0, "add_to_cart", None),
    ("click", 0, 69, 2, 90, "begin_checkout", None),
    ("click", 0, 39, 3, 150, "begin_checkout", None),
    ("click", 0, 24, 4, 200, "add_shipping_info", None),
    ("error", 0, 99, 1, 0, "begin_checkout", None),
    ("error", 0, 69, 2, 60, "add_shipping_info", None),
    ("error", 0, 49, 3, 130, "page_view", "Payment Method"),
    ("error", 0, 49, 4, 130, "add_payment_info", None),
    ("error", 0, 24, 5, 190, "page_view", "Payment Method"),
    ("error", 0, 24, 6, 190, "add_payment_info", None),
    ("error", 25, 34, 7, 200, "page_view", "Checkout Your Information"),
    ("purchase", 0, 99, 1, 0, "user_engagement", None),
    ("purchase", 0, 79, 2, 10, "begin_checkout", None),
    ("purchase", 0, 19, 3, 30, "begin_checkout", None),
    ("purchase", 0, 94, 4, 60, "add_shipping_info", None),
    ("purchase", 0, 99, 5, 110, "page_view", "Payment Method"),
    ("purchase", 0, 99, 6, 110, "add_payment_info", None),
    ("purchase", 60, 79, 7, 140, "page_view", "Payment Method"),
    ("purchase", 0, 99, 8, 170, "purchase", None),
    ("purchase", 0, 99, 9, 175, "page_view", "Checkout Confirmation"),
)
# Browser and operating system by segment index 0..7.
SEGMENT_BROWSER = ("Chrome", "Chrome", "Chrome", "Chrome", "Safari", "Safari", "Firefox", "Chrome")
SEGMENT_OS = ("Macintosh", "Windows", "iOS", "Android", "Macintosh", "iOS", "Windows", "Linux")
# ---------------------------------------------------------------------------

MICROS_PER_DAY = 86_400_000_000


def _sql_str(v) -> str:
    return "CAST(NULL AS STRING)" if v is None else "'" + str(v).replace("'", "\\'") + "'"


def _template_sql() -> str:
    """The template as one SQL literal (a single JVM call to build):
    ``map<event_type, array<struct<kmin,kmax,step,off,event_name,page_title>>>``."""
    by_type: dict[str, list[str]] = {}
    for etype, kmin, kmax, step, off, name, title in JOURNEY_TEMPLATE:
        by_type.setdefault(etype, []).append(
            f"named_struct('kmin', {kmin}, 'kmax', {kmax}, 'step', {step}, 'off', {off}, "
            f"'event_name', {_sql_str(name)}, 'page_title', {_sql_str(title)})")
    return "map(" + ", ".join(f"{_sql_str(t)}, array({', '.join(rows)})" for t, rows in by_type.items()) + ")"


def _lookup_sql(values: tuple[str, ...], index_col: str) -> str:
    return f"element_at(array({', '.join(_sql_str(v) for v in values)}), {index_col} + 1)"


EVENTS_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"

# Epoch microseconds of a TIMESTAMP_NTZ read as UTC: TIMESTAMPDIFF on NTZ
# values is evaluated in UTC whatever the session time zone is.
_NTZ_MICROS = "TIMESTAMPDIFF(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
_EVENT_US = "us + CAST(off AS BIGINT) * 1000000 * (k % 7 + 1)"
_SEG = "CAST((user_id * 10 + k % 10 + CASE WHEN event_id % 20 = 0 THEN 3 ELSE 0 END) % 8 AS INT)"


def _yyyymmdd_sql(us: str) -> str:
    d = f"date_from_unix_date(CAST(FLOOR(({us}) / {MICROS_PER_DAY}) AS INT))"
    return f"CAST(year({d}) * 10000 + month({d}) * 100 + dayofmonth({d}) AS STRING)"


def adapt_events(events: DataFrame) -> DataFrame:
    """``events(event_id, ts, user_id, event_type, value, props)`` -> raw_events.

    Written as three ``selectExpr`` steps: a narrow projection, a generator
    over the template literal with a plain filter, and the output
    projection (one JVM call each while the plan is built)."""
    ts_micros = _NTZ_MICROS if dict(events.dtypes)["ts"] == "timestamp_ntz" else "unix_micros(ts)"
    src = events.selectExpr("event_id", "user_id", "event_type", "value",
                            "CAST(get_json_object(props, '$.k') AS INT) AS k", f"{ts_micros} AS us")
    expanded = src.selectExpr("*", f"inline(element_at({_template_sql()}, event_type))").where(
        "k BETWEEN kmin AND kmax")
    return expanded.selectExpr(
        "concat(CAST(user_id AS STRING), '.', CAST(k % 10 AS STRING)) AS user_pseudo_id",
        "event_name",
        "page_title",
        f"{_yyyymmdd_sql(_EVENT_US)} AS event_date",
        f"{_EVENT_US} AS event_timestamp",
        f"{_lookup_sql(SEGMENT_BROWSER, _SEG)} AS browser",
        f"{_lookup_sql(SEGMENT_OS, _SEG)} AS operating_system",
        "CASE WHEN event_name = 'purchase' THEN value END AS purchase_revenue_in_usd",
        "event_id * 10 + step AS event_seq",
    )


def load_raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_events derived from ``{sf_dir}/events.parquet`` (only the six
    columns the adapter needs are read, with a declared schema)."""
    return adapt_events(spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir.rstrip('/')}/events.parquet"))
