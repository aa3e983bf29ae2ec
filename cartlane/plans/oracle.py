"""DuckDB SQL for every catalog key (see ``oracle_base``).

Parameters are those of the catalog: cutoff 2024-01-25 where the analysis has
a date filter, none where it has none, AOV 66.54.
"""

from __future__ import annotations

from cartlane.config import CHURN_STEPS, CLEAN_CHECKPOINTS, FUNNEL_STEPS, SEGMENT_BROWSERS, SEGMENT_SYSTEMS
from cartlane.operators.clean_path import COUNT_NAMES as CHECKPOINT_NAMES
from cartlane.operators.funnel import RATE_NAMES
from cartlane.operators.sequences import COUNT_NAMES as STEP_NAMES
from cartlane.functions.labels import LAG_NAMES
from cartlane.plans.oracle_base import LABELS_CTE, UNSEQUENCED_CTE, half_up, histories, query, r2, sql_list

CUTOFF = "DATE '2024-01-25'"
IN_SEGMENT = (f"list_contains({sql_list(SEGMENT_BROWSERS)}, browser) "
              f"AND list_contains({sql_list(SEGMENT_SYSTEMS)}, operating_system)")
# An amount in units of 1e-10, an exact integer.
UNITS = "CAST(round(purchase_revenue_in_usd * 10000000000) AS HUGEINT)"
ORACLE: dict[str, str] = {}

ORACLE["normalize_events"] = query() + """
SELECT user_pseudo_id, event_name, page_title, event_date, event_timestamp, event_us,
       browser, operating_system, purchase_revenue_in_usd, event_seq
FROM typed"""
ORACLE["checkout_labels"] = query(LABELS_CTE) + "SELECT * EXCLUDE (page_title) FROM labels_of_events"


# --- user-days and durations -----------------------------------------------------
def user_days(where: str = "true", name: str = "user_days") -> str:
    """One grouped query: facts of every (user, day) with a purchase."""
    return f"""{name} AS (
  SELECT user_pseudo_id, event_date, min(event_us) AS start_us, min(event_us) FILTER (event_name = 'purchase') AS buy_us,
         max(browser) FILTER (event_name = 'purchase') AS browser,
         max(operating_system) FILTER (event_name = 'purchase') AS operating_system,
         max([browser, operating_system]) FILTER (event_name = 'purchase') AS pair,
         count(purchase_revenue_in_usd) FILTER (event_name = 'purchase') AS paid,
         sum({UNITS}) FILTER (event_name = 'purchase') AS units,
         (min(event_us) FILTER (event_name = 'purchase') - min(event_us)) // 60000000 AS minutes
  FROM typed WHERE {where} GROUP BY ALL HAVING buy_us IS NOT NULL
)"""


_MICROS = half_up("units", "paid * 10000", 1)


def _facts(browser: str, system: str) -> str:
    return query(user_days()) + f"""
SELECT user_pseudo_id, event_date, make_timestamp(start_us) AS first_event_time,
       make_timestamp(buy_us) AS first_purchase_time, minutes AS minutes_to_purchase,
       {browser} AS browser, {system} AS operating_system,
       CAST({_MICROS} AS BIGINT) AS revenue_micros, CAST({_MICROS} AS DOUBLE) / 1000000 AS avg_purchase_revenue
FROM user_days"""


ORACLE["user_day_facts"] = _facts("browser", "operating_system")
ORACLE["user_day_facts_paired"] = _facts("pair[1]", "pair[2]")
ORACLE["purchase_revenue_user_day"] = query(user_days()) + f"""
SELECT user_pseudo_id, event_date, CAST({_MICROS} AS DOUBLE) / 1000000 AS purchase_revenue_in_usd, paid AS revenue_events
FROM user_days"""


def _durations(keys: str, where: str, tag: str = "") -> tuple[str, ...]:
    """Daily means and the mean of the rounded daily means, by ``keys``, as cents of a minute."""
    k = f"{keys}, " if keys else ""
    return (user_days(where, f"days{tag}"), f"""daily{tag} AS (
  SELECT event_date, {k}count(*) AS n, {half_up('sum(minutes)', 'count(*)', 100)} AS c
  FROM days{tag} WHERE event_date <= {CUTOFF} GROUP BY ALL)""", f"""total{tag} AS (
  SELECT {k}CAST(sum(n) AS BIGINT) AS n, {half_up('sum(c)', 'count(*)', 1)} AS c FROM daily{tag}
  {'GROUP BY ' + keys if keys else ''})""")


def _duration_rows(keys: str, where: str) -> str:
    k = f", {keys}" if keys else ""
    return query(*_durations(keys, where)) + f"""
SELECT event_date AS purchase_date, CAST(c AS DOUBLE) / 100 AS avg_minutes_to_purchase, n AS no_of_purchases{k},
       'Daily' AS result_type FROM daily
UNION ALL BY NAME
SELECT NULL::DATE AS purchase_date, CAST(c AS DOUBLE) / 100 AS avg_minutes_to_purchase, n AS no_of_purchases{k},
       'Overall' AS result_type FROM total"""


_SEGMENT_KEYS = "browser, operating_system"
ORACLE["daily_purchase_duration"] = _duration_rows("", "true")
ORACLE["purchase_duration_by_segment"] = _duration_rows(_SEGMENT_KEYS, IN_SEGMENT)
ORACLE["purchase_weighted_duration"] = query(user_days()) + f"""
SELECT {r2('sum(minutes)', 'count(*)')} AS avg_minutes_to_purchase, count(*) AS no_of_purchases
FROM user_days WHERE event_date <= {CUTOFF}"""
ORACLE["segment_gaps"] = query(*_durations(_SEGMENT_KEYS, IN_SEGMENT, "_s"), *_durations("", "true", "_a")) + """
SELECT browser, operating_system, CAST(c AS DOUBLE) / 100 AS avg_minutes_to_purchase, n AS no_of_purchases,
       CAST((SELECT c FROM total_a) AS DOUBLE) / 100 AS overall_avg_minutes,
       CAST(c - (SELECT c FROM total_a) AS DOUBLE) / 100 AS gap_minutes
FROM total_s"""
ORACLE["slowest_segment"] = ORACLE["segment_gaps"] + " ORDER BY gap_minutes DESC, browser, operating_system LIMIT 1"
ORACLE["aov"] = query() + f"""
SELECT CAST(sum(CAST(purchase_revenue_in_usd AS DECIMAL(28, 10))) AS DOUBLE) / count(purchase_revenue_in_usd) AS aov,
       count(purchase_revenue_in_usd) AS purchase_events
FROM typed WHERE event_name = 'purchase' AND event_date <= {CUTOFF}"""


# --- funnel -----------------------------------------------------------------------
def _funnel(count: str, least: int) -> str:
    """Counts per segment and step in one grouped query; a count up to ``least`` is 0."""
    cells = ", ".join(f"{count} FILTER (event_name = '{s}') AS {s}" for s in FUNNEL_STEPS)
    kept = ", ".join(f"CASE WHEN {s} > {least} THEN {s} ELSE 0 END AS {s}" for s in FUNNEL_STEPS)
    return query(f"""cells AS (SELECT browser, operating_system, {cells} FROM typed WHERE {IN_SEGMENT} GROUP BY ALL)""",
                 f"""funnel AS (SELECT browser, operating_system, {kept} FROM cells
  WHERE greatest({', '.join(FUNNEL_STEPS)}) > {least})""")


_COUNTS = _funnel("count(user_pseudo_id)", 1)
_RATES = ", ".join(f"{r2(f'{s} * 100', 'first_visit')} AS {RATE_NAMES[s]}" for s in FUNNEL_STEPS)
ORACLE["funnel_counts"] = _COUNTS + "SELECT * FROM funnel"
ORACLE["funnel_users"] = _funnel("count(DISTINCT user_pseudo_id)", 0) + "SELECT * FROM funnel"
ORACLE["funnel_rates"] = _COUNTS + f"SELECT operating_system, browser, {_RATES} FROM funnel"
ORACLE["funnel_counts_and_rates"] = _COUNTS + f"SELECT *, {_RATES} FROM funnel"
ORACLE["funnel_step_dropoff"] = _COUNTS + f"""
, long AS (SELECT browser, operating_system, unnest(range(2, {len(FUNNEL_STEPS) + 1})) AS i,
             {sql_list(FUNNEL_STEPS)} AS names, [{', '.join(FUNNEL_STEPS)}] AS n FROM funnel),
pairs AS (SELECT *, names[i] AS step, names[i - 1] AS previous_step, n[i] AS events, n[i - 1] AS previous_events FROM long)
SELECT browser, operating_system, CAST(i AS INT) AS step_index, step, previous_step, events, previous_events,
       CAST({half_up('events * 100', 'previous_events', 100)} AS DOUBLE) / 100 AS prct_of_previous,
       CAST(10000 - {half_up('events * 100', 'previous_events', 100)} AS DOUBLE) / 100 AS dropoff_prct
FROM pairs"""

# --- histories, churn, friction ------------------------------------------------------
_HISTORY = histories("user_pseudo_id")
_LAGS = ", ".join(f"prior[{i}] AS {c}" for i, c in enumerate(LAG_NAMES, 1))
_CHURNED = f"ends AND list_contains({sql_list(CHURN_STEPS)}, event_label)"
_STEP_COUNTS = ", ".join(f"CAST(len([x FOR x IN prior IF x = '{s}']) AS INT) AS {c}" for s, c in STEP_NAMES.items())
# Friction of a churner: the last step is among the prior ones; of a completer: a churn step is there twice.
_AGAIN = "list_contains(prior, event_label)"
_TWICE = f"list_bool_or([len([x FOR x IN prior IF x = s]) > 1 FOR s IN {sql_list(CHURN_STEPS)}])"

_PRIOR = f"SELECT user_pseudo_id, event_date, event_timestamp, event_seq, event_label, {_LAGS} FROM steps"
_CHURNERS = f"""SELECT user_pseudo_id, event_date, event_timestamp, event_label AS churn_event, {_LAGS} FROM steps
WHERE {_CHURNED}"""
_SESSION = ("user_pseudo_id", "event_date")
ORACLE["prior_event_sequence"] = query(*_HISTORY) + _PRIOR
ORACLE["checkout_churners"] = query(*_HISTORY) + _CHURNERS
ORACLE["checkout_churners_session"] = query(*histories(*_SESSION)) + _CHURNERS
ORACLE["prior_event_sequence_unsequenced"] = query(*_HISTORY, typed=UNSEQUENCED_CTE) + _PRIOR
ORACLE["checkout_churners_unsequenced"] = query(*_HISTORY, typed=UNSEQUENCED_CTE) + _CHURNERS


def _groups(where: str, name: str, scope: tuple[str, ...] = ("user_pseudo_id",)) -> tuple[str, ...]:
    return (*histories(*scope), f"""groups AS (
  SELECT event_label, prior, count(*) AS sequences, count(DISTINCT user_pseudo_id) AS users
  FROM steps WHERE {where} GROUP BY ALL)""")


for _kind, _where, _name in (("completer", "event_label = 'purchase'", "current_event"),
                             ("churner", _CHURNED, "last_event")):
    _sql = query(*_groups(_where, _name)) + f"SELECT event_label AS {_name}, {_LAGS}, sequences, users"
    ORACLE[f"{_kind}_sequences"] = _sql + " FROM groups"
    ORACLE[f"{_kind}_friction"] = _sql + f", {_STEP_COUNTS} FROM groups"


def _risk(users: str) -> str:
    return f"floor(CAST({users} AS DOUBLE) * CAST(66.54 AS DOUBLE) * 100 + 0.5) / 100"


def _frictioned(scope: tuple[str, ...]) -> tuple[str, ...]:
    """Friction groups of both kinds with their begin-checkout and payment touches."""
    return (*_groups(f"event_label = 'purchase' OR ({_CHURNED})", "", scope), f"""frictioned AS (
  SELECT event_label = 'purchase' AS completer, users, len([x FOR x IN prior IF x = 'begin_checkout']) AS b,
         len([x FOR x IN prior IF x IN ('Payment Method', 'add_payment_info')]) AS p
  FROM groups WHERE CASE WHEN event_label = 'purchase' THEN {_TWICE} ELSE {_AGAIN} END)""")


def _segments(scope: tuple[str, ...]) -> str:
    names = "(VALUES (false, 'Friction Churners', 'Lost Revenue'), (true, 'Friction Completers', 'At-Risk Revenue Retained'))"
    return query(*_frictioned(scope)) + f"""
SELECT s.segment, s.revenue_label, count(users) AS sequences, CAST(sum(users) AS BIGINT) AS affected_users,
       {_risk('sum(users)')} AS revenue_at_risk,
       CAST(sum(b) AS DOUBLE) / nullif(count(users), 0) AS avg_begin_checkout,
       {r2('sum(b * users)', 'sum(users)')} AS user_avg_begin_checkout, CAST(max(b) AS INT) AS max_begin_checkout,
       CAST(sum(p) AS DOUBLE) / nullif(count(users), 0) AS avg_payment_touches,
       {r2('sum(p * users)', 'sum(users)')} AS user_avg_payment_touches, CAST(max(p) AS INT) AS max_payment_touches
FROM {names} AS s(completer, segment, revenue_label) LEFT JOIN frictioned f ON f.completer = s.completer
GROUP BY s.segment, s.revenue_label"""


_USER = ("user_pseudo_id",)
ORACLE["friction_segments"] = _segments(_USER)
ORACLE["friction_segments_session"] = _segments(_SESSION)
ORACLE["friction_revenue_total"] = query(*_frictioned(_USER)) + f"""
SELECT CAST(coalesce(sum(users), 0) AS BIGINT) AS friction_affected_users,
       {_risk('coalesce(sum(users), 0)')} AS revenue_at_risk
FROM frictioned"""



def _churn_rows(scope: tuple[str, ...]) -> tuple[str, ...]:
    return (*histories(*scope), f"""churned AS (
  SELECT user_pseudo_id AS u, event_label AS last_event, prior, {_AGAIN} AS friction FROM steps WHERE {_CHURNED})""")


_CHURN_ROWS = _churn_rows(_USER)
for _name, _scope in (("churn_summary", _USER), ("churn_summary_session", _SESSION)):
    ORACLE[_name] = query(*_churn_rows(_scope)) + f""", counts AS (
SELECT count(*) AS churner_rows, count(DISTINCT u) AS checkout_churners,
       count(DISTINCT (u, last_event, prior)) FILTER (friction) AS friction_affected_users,
       count(DISTINCT u) FILTER (friction) AS friction_churners_distinct
FROM churned)
SELECT *, {r2('friction_affected_users * 100', 'checkout_churners')} AS friction_share_prct,
       {r2('friction_churners_distinct * 100', 'checkout_churners')} AS distinct_friction_share_prct
FROM counts"""
ORACLE["churners_by_last_event"] = query(*_CHURN_ROWS) + """
SELECT last_event, count(*) AS churn_rows, count(DISTINCT prior) AS sequences,
       count(DISTINCT (u, prior)) AS affected_users, count(DISTINCT u) AS distinct_users
FROM churned WHERE friction GROUP BY last_event"""
ORACLE["churner_shares"] = query(*_CHURN_ROWS) + f""", per_step AS (
SELECT last_event, count(DISTINCT (u, prior)) AS affected_users FROM churned WHERE friction GROUP BY last_event)
SELECT *, CAST(sum(affected_users) OVER () AS BIGINT) AS all_affected_users,
       {r2('affected_users * 100', 'CAST(sum(affected_users) OVER () AS BIGINT)')} AS share_prct
FROM per_step"""
ORACLE["payment_step_churners"] = query(*_CHURN_ROWS) + """
SELECT count(*) AS payment_churn_rows, count(DISTINCT u) AS payment_churn_users,
       count(DISTINCT u) FILTER (friction) AS friction_payment_churn_users
FROM churned WHERE last_event IN ('Payment Method', 'add_payment_info')"""
ORACLE["payment_return_churners"] = query(*_CHURN_ROWS) + """
SELECT count(*) AS return_churn_rows, count(DISTINCT u) AS return_churn_users
FROM churned WHERE last_event = 'Payment Method' AND list_contains(prior, 'add_payment_info')"""
ORACLE["shipping_redirects"] = query(*_HISTORY) + """
SELECT count(*) AS redirect_events, count(DISTINCT user_pseudo_id) AS redirect_users
FROM steps WHERE event_label = 'begin_checkout' AND prior[1] = 'add_shipping_info'"""

# --- clean path -------------------------------------------------------------------------
# Per (user, day): the first checkout and, in lists, the checkpoints' times.
_times = ", ".join(f"list(event_us) FILTER (event_label = '{c}') AS t{i}" for i, c in enumerate(CLEAN_CHECKPOINTS))
_after = [f"CAST(len([x FOR x IN coalesce(t{i}, []) IF x >= checkout_us]) AS BIGINT)" for i in range(len(CLEAN_CHECKPOINTS))]
_CHECKOUTS = (LABELS_CTE, f"""checkouts AS (
  SELECT user_pseudo_id, event_date, min(event_us) FILTER (event_label = 'begin_checkout') AS checkout_us,
         bool_or(event_label = 'purchase') AS purchased, {_times}
  FROM labels_of_events GROUP BY ALL HAVING checkout_us IS NOT NULL)""", f"""clean_days AS (
  SELECT user_pseudo_id, event_date FROM checkouts WHERE purchased AND {' AND '.join(f'{a} = 1' for a in _after)})""")
ORACLE["checkout_start"] = query(*_CHECKOUTS) + """
SELECT user_pseudo_id, event_date, make_timestamp(checkout_us) AS checkout_time FROM checkouts"""
ORACLE["checkpoint_counts"] = query(*_CHECKOUTS) + f"""
SELECT user_pseudo_id, event_date, make_timestamp(checkout_us) AS checkout_time,
       {', '.join(f'{a} AS {CHECKPOINT_NAMES[c]}' for a, c in zip(_after, CLEAN_CHECKPOINTS))}, purchased
FROM checkouts"""
ORACLE["clean_path_user_days"] = query(*_CHECKOUTS) + "SELECT * FROM clean_days"


def _paths(fanout: str) -> tuple[str, ...]:
    """Both groups' purchases with a weight (clean purchases count once, or once per clean day of the user), their
    daily rows in cents, and the summary rows."""
    weight = "k" if fanout == "reference" else "1"
    return (*_CHECKOUTS, user_days(), f"""weighed AS (
  SELECT 'Overall' AS kind, event_date, minutes, {half_up('units', 'paid', 1)} AS rev, 1 AS w FROM user_days
  UNION ALL
  SELECT 'Clean Path', event_date, minutes, {half_up('units', 'paid', 1)}, {weight}
  FROM user_days SEMI JOIN clean_days USING (user_pseudo_id, event_date)
  JOIN (SELECT user_pseudo_id, count(*) AS k FROM clean_days GROUP BY 1) USING (user_pseudo_id))""", f"""daily AS (
  SELECT kind, event_date, CAST(sum(w) AS BIGINT) AS n, {half_up('sum(minutes * w)', 'sum(w)', 100)} AS mc,
         {half_up('sum(rev * w)', 'sum(w) FILTER (rev IS NOT NULL) * 10000000000', 100)} AS rc
  FROM weighed WHERE event_date <= {CUTOFF} GROUP BY ALL)""", f"""total AS (
  SELECT kind, CAST(sum(n) AS BIGINT) AS n, {half_up('sum(mc)', 'count(*)', 1)} AS mc,
         {half_up('sum(rc)', 'count(rc)', 1)} AS rc FROM daily GROUP BY kind)""")


def _clean_rows(fanout: str) -> str:
    return query(*_paths(fanout)) + """
SELECT event_date AS purchase_date, CAST(mc AS DOUBLE) / 100 AS avg_minutes_to_purchase, n AS no_of_purchases,
       CAST(rc AS DOUBLE) / 100 AS overall_avg_revenue_purchase, kind AS result_type FROM daily
UNION ALL
SELECT NULL, CAST(mc AS DOUBLE) / 100, n, CAST(rc AS DOUBLE) / 100, kind || ' Average' FROM total"""


ORACLE["clean_vs_overall"] = _clean_rows("reference")
ORACLE["clean_vs_overall_session"] = _clean_rows("session")
ORACLE["aov_candidates"] = query(*_paths("reference")) + f"""
SELECT 'transaction_weighted' AS candidate,
       CAST(sum(CAST(purchase_revenue_in_usd AS DECIMAL(28, 10))) AS DOUBLE) / count(purchase_revenue_in_usd) AS value,
       true AS chosen
FROM typed WHERE event_name = 'purchase' AND event_date <= {CUTOFF}
UNION ALL
SELECT CASE kind WHEN 'Overall' THEN 'overall_daily_mean' ELSE 'clean_path_daily_mean' END, CAST(rc AS DOUBLE) / 100, false
FROM total"""
ORACLE["clean_path_speedup"] = query(*_paths("reference")) + f""", pair AS (
SELECT max(mc) FILTER (kind = 'Overall') AS o, max(mc) FILTER (kind = 'Clean Path') AS c FROM total)
SELECT CAST(o AS DOUBLE) / 100 AS overall_avg_minutes, CAST(c AS DOUBLE) / 100 AS clean_avg_minutes,
       {r2('(o - c) * 100', 'o')} AS speedup_prct
FROM pair"""

# --- population -----------------------------------------------------------------------------
ORACLE["population_counts"] = query() + f"""
SELECT count(DISTINCT user_pseudo_id) AS unique_users,
       count(DISTINCT user_pseudo_id) FILTER (event_name = 'begin_checkout') AS checkout_initiators,
       count(DISTINCT user_pseudo_id) FILTER (event_name = 'purchase') AS purchasers
FROM typed WHERE event_date <= {CUTOFF}"""
ORACLE["missing_step_share"] = query("""flags AS (
  SELECT bool_or(event_name = 'begin_checkout') AS began,
         coalesce(bool_or(event_name = 'page_view' AND page_title = 'Checkout Your Information'), false) AS saw
  FROM typed GROUP BY user_pseudo_id)""") + f"""
SELECT count(*) AS checkout_starters, count(*) FILTER (NOT saw) AS missing_page_starters,
       {r2('count(*) FILTER (NOT saw) * 100', 'count(*)')} AS missing_share_prct
FROM flags WHERE began"""

# --- the same reports from daily partials (the approximate user counts have no exact SQL) ---
ORACLE["purchase_duration_from_partials"] = ORACLE["daily_purchase_duration"]
ORACLE["segment_duration_from_partials"] = ORACLE["purchase_duration_by_segment"]
ORACLE["funnel_counts_from_partials"] = ORACLE["funnel_counts"]
ORACLE["aov_from_partials"] = ORACLE["aov"]
ORACLE["user_day_facts_clustered"] = ORACLE["user_day_facts"]
ORACLE["friction_segments_clustered"] = ORACLE["friction_segments"]
