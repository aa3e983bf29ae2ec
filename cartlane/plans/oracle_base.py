"""What the DuckDB checks share.

The checks are written in another form than the Spark operators: histories are
slices of one ordered list per user, the clean path counts in lists, facts come
from one grouped query with FILTER clauses, ratios are integer divisions.
Conventions: whole minutes, half-up rounding on exact integer ratios, money in
units of 1e-10, event order (event_timestamp, event_seq).
"""

from __future__ import annotations

from cartlane.config import CHECKOUT_PAGES, NOISE_EVENTS
from cartlane.sources.fixture import JOURNEY_TEMPLATE, SEGMENT_BROWSER, SEGMENT_OS


def _sql_lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v)


def sql_list(vals) -> str:
    return "[" + ", ".join(_sql_lit(v) for v in vals) + "]"


def _template_values() -> str:
    return ",\n    ".join("(" + ", ".join(_sql_lit(v) for v in row) + ")" for row in JOURNEY_TEMPLATE)


RAW_EVENTS_CTE = f"""raw_events AS (
  SELECT concat(e.user_id, '.', e.k % 10) AS user_pseudo_id,
         t.event_name,
         t.page_title,
         strftime(make_timestamp(e.us + CAST(t.off AS BIGINT) * 1000000 * (1 + e.k % 7)), '%Y%m%d') AS event_date,
         e.us + CAST(t.off AS BIGINT) * 1000000 * (1 + e.k % 7) AS event_timestamp,
         ({sql_list(SEGMENT_BROWSER)})[((e.user_id * 10 + e.k % 10 + CASE WHEN e.event_id % 20 = 0 THEN 3 ELSE 0 END) % 8) + 1] AS browser,
         ({sql_list(SEGMENT_OS)})[((e.user_id * 10 + e.k % 10 + CASE WHEN e.event_id % 20 = 0 THEN 3 ELSE 0 END) % 8) + 1] AS operating_system,
         CASE WHEN t.event_name = 'purchase' THEN e.value END AS purchase_revenue_in_usd,
         e.event_id * 10 + t.step AS event_seq
  FROM (SELECT event_id, user_id, event_type, value,
               CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
               epoch_us(ts) AS us
        FROM events) e
  JOIN (VALUES
    {_template_values()}
  ) AS t(event_type, kmin, kmax, step, off, event_name, page_title)
    ON e.event_type = t.event_type AND e.k BETWEEN t.kmin AND t.kmax
)"""

TYPED_CTE = """typed AS (
  SELECT r.* EXCLUDE (event_date, event_timestamp),
         strptime(r.event_date, '%Y%m%d')::DATE AS event_date,
         make_timestamp(r.event_timestamp) AS event_timestamp,
         r.event_timestamp AS event_us
  FROM raw_events r
)"""

# The same for a table without a sequence: ties are ordered by date, name and title.
UNSEQUENCED_CTE = """typed AS (
  SELECT r.* EXCLUDE (event_date, event_timestamp, event_seq),
         strptime(r.event_date, '%Y%m%d')::DATE AS event_date,
         make_timestamp(r.event_timestamp) AS event_timestamp,
         r.event_timestamp AS event_us,
         concat_ws('|', r.event_date, r.event_name, r.page_title) AS event_seq
  FROM raw_events r
)"""

# A page view is its title if that is a checkout page; any other event is its name unless it is noise.
LABELS_CTE = f"""labels_of_events AS (
  SELECT *, page_title AS event_label FROM typed
  WHERE event_name = 'page_view' AND list_contains({sql_list(CHECKOUT_PAGES)}, page_title)
  UNION ALL
  SELECT *, event_name AS event_label FROM typed
  WHERE event_name <> 'page_view' AND NOT list_contains({sql_list(NOISE_EVENTS)}, event_name)
)"""


def histories(*keys: str) -> tuple[str, ...]:
    """Every labelled event ``e`` with the ordered list ``h`` of its user's (or session's) events and its place."""
    k = ", ".join(keys)
    return (
        LABELS_CTE,
        f"""ordered AS (
  SELECT {k}, list(struct_pack(label := event_label, d := event_date, us := event_us, seq := event_seq,
                               who := user_pseudo_id) ORDER BY event_us, event_seq) AS h
  FROM labels_of_events GROUP BY {k}
)""",
        """placed AS (SELECT h, h[-1].us AS last_us, list_bool_or([x.label = 'purchase' FOR x IN h]) AS bought,
                             unnest(range(1, len(h) + 1)) AS i FROM ordered)""",
        """steps AS (
  SELECT h[i].who AS user_pseudo_id, h[i].d AS event_date, make_timestamp(h[i].us) AS event_timestamp,
         h[i].seq AS event_seq, h[i].label AS event_label, h[i].us = last_us AND NOT bought AS ends,
         [CASE WHEN i > k THEN h[i - k].label END FOR k IN [1, 2, 3, 4, 5]] AS prior
  FROM placed
)""")


def query(*ctes: str, typed: str = TYPED_CTE) -> str:
    return "WITH " + ",\n".join((RAW_EVENTS_CTE, typed, *ctes)) + "\n"


def fdiv(a: str, b: str) -> str:
    """Floor division for b > 0 (DuckDB's // truncates toward zero)."""
    return f"((({a}) - ((({a}) % ({b})) + ({b})) % ({b})) // ({b}))"


def half_up(num: str, den: str, factor: int) -> str:
    """round(num / den * factor) half up on integers, NULL for a zero denominator."""
    return fdiv(f"2 * {factor} * ({num}) + ({den})", f"NULLIF(2 * ({den}), 0)")


def r2(num: str, den: str) -> str:
    """round(num / den, 2) half up on integers."""
    return f"(CAST({half_up(num, den, 100)} AS DOUBLE) / 100)"
