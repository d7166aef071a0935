"""The same queries as SQL over the same tables."""

from __future__ import annotations

_EVENTS = "(SELECT *, (epoch_us(ts) // 1000) AS ms, epoch_us(ts) AS us, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"

_LINES = """(SELECT *, CASE
    WHEN l_linenumber = 7 THEN 'too many fields: 8, allowed 7'
    WHEN l_linenumber = 6 THEN 'too few fields: 3, need 6'
    WHEN l_discount = CAST(0.1 AS DOUBLE) THEN 'required field l_extendedprice is empty'
    WHEN l_returnflag = 'R' THEN 'field l_quantity is not a valid float' END AS error
  FROM lineitem)"""

_METRIC_LINES = f"""(SELECT *, 'events.' || event_type AS metric,
    CASE event_type WHEN 'click' THEN us // 1000000 * 1000000 WHEN 'view' THEN us // 1000 * 1000 ELSE us END AS ts_us,
    CASE WHEN k < 10 THEN CAST(user_id AS VARCHAR) ELSE 'again' END AS user_attr
  FROM {_EVENTS} WHERE event_type <> 'error')"""

_ORDER_CONTROL = """(SELECT epoch_us(o_orderdate) AS us, o_orderkey AS seq,
    CASE WHEN o_totalprice > 499000 THEN 'clear' WHEN o_totalprice > 490000 THEN 'rename'
         WHEN o_orderstatus = 'F' THEN 'set'
         WHEN o_orderstatus = 'O' THEN CASE WHEN o_totalprice < 150000 THEN 'unset' ELSE 'undelete' END
         ELSE CASE WHEN o_totalprice < 100000 THEN 'delete' ELSE 'set' END END AS action,
    CASE WHEN o_totalprice > 480000 THEN NULL WHEN o_totalprice < 20000 THEN 'l_returnflag'
         ELSE o_orderpriority END AS name,
    CASE WHEN o_orderpriority = '3-MEDIUM' THEN CASE WHEN o_totalprice > 50000 THEN o_orderstatus END
         ELSE CAST(o_custkey AS VARCHAR) END AS value
  FROM orders)"""

_EVENT_CONTROL = f"""(SELECT us, event_id AS seq,
    CASE WHEN k < 50 THEN 'set' WHEN k < 65 THEN 'unset' WHEN k < 80 THEN 'delete' WHEN k < 95 THEN 'undelete'
         ELSE 'clear' END AS action,
    CASE event_type WHEN 'error' THEN 'event_type' ELSE event_type END AS name,
    CAST(k AS VARCHAR) AS value
  FROM {_EVENTS})"""


def _annotated(control: str, data: str, own: dict[str, str], output: str) -> str:
    """Per row and label name: its last edit before the row, unless a clear came later."""
    own_names = ", ".join(f"('{n}')" for n in own)
    own_value = "CASE n.name " + " ".join(f"WHEN '{n}' THEN d.{c}" for n, c in own.items()) + " END"
    return f"""
WITH ctl AS {control},
clears AS (SELECT us, max(seq) AS seq FROM ctl WHERE action = 'clear' GROUP BY us),
adds AS (SELECT us, name, max(seq) AS seq, arg_max(action = 'set', seq) AS live, arg_max(coalesce(value, ''), seq) AS value
  FROM ctl WHERE name IS NOT NULL AND (action = 'unset' OR (action = 'set' AND value IS NOT NULL)) GROUP BY us, name),
drops AS (SELECT us, name, max(seq) AS seq, arg_max(action = 'delete', seq) AS live
  FROM ctl WHERE name IS NOT NULL AND action IN ('delete', 'undelete') GROUP BY us, name),
names AS (SELECT name FROM adds UNION SELECT name FROM drops UNION SELECT * FROM (VALUES {own_names})),
d AS (SELECT *, row_number() OVER () AS rid FROM {data}),
r AS (SELECT d.rid, d.us, n.name, {own_value} AS own FROM d, names n),
a AS (SELECT r.*, adds.us AS a_us, adds.seq AS a_seq, adds.live AS a_live, adds.value AS a_value
  FROM r ASOF LEFT JOIN adds ON r.name = adds.name AND r.us > adds.us),
b AS (SELECT a.*, drops.us AS d_us, drops.seq AS d_seq, drops.live AS d_live
  FROM a ASOF LEFT JOIN drops ON a.name = drops.name AND a.us > drops.us),
c AS (SELECT b.*, clears.us AS c_us, clears.seq AS c_seq FROM b ASOF LEFT JOIN clears ON b.us > clears.us),
l AS (SELECT rid, name,
    CASE WHEN coalesce(a_live, false) AND (c_us IS NULL OR a_us > c_us OR (a_us = c_us AND a_seq > c_seq)) THEN a_value ELSE own END AS value,
    coalesce(d_live, false) AND (c_us IS NULL OR d_us > c_us OR (d_us = c_us AND d_seq > c_seq)) AS dropped
  FROM c),
t AS (SELECT rid, string_agg(name || '=' || value, ',' ORDER BY name) AS labels FROM l WHERE value IS NOT NULL AND NOT dropped GROUP BY rid)
SELECT {output}, coalesce(t.labels, '') AS labels FROM d LEFT JOIN t ON d.rid = t.rid"""


_ANNOTATE_LINES = _annotated(
    _ORDER_CONTROL,
    "(SELECT *, epoch_us(l_shipdate) AS us FROM lineitem)",
    {"l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus"},
    "d.l_orderkey, d.l_linenumber, d.l_partkey, (epoch_us(d.l_shipdate) // 1000) AS ts_ms",
)

_ANNOTATE_EVENTS = _annotated(
    _EVENT_CONTROL,
    f"""(SELECT 'value' AS name, us, CAST(user_id AS VARCHAR) AS uid, event_type, CAST(round(value * 100) AS BIGINT) AS cents FROM {_EVENTS}
  UNION ALL SELECT 'k', us, CAST(user_id AS VARCHAR), event_type, k * 100 FROM {_EVENTS})""",
    {"user_id": "uid", "event_type": "event_type"},
    "d.name, d.us AS ts_us, d.cents",
)

_EVENT_SAMPLES = f"""(
  SELECT 'value' AS name, 'gauge' AS metric_type, ms, value, user_id, event_type FROM {_EVENTS}
  UNION ALL SELECT 'k', 'counter', ms, CAST(k AS DOUBLE), user_id, event_type FROM {_EVENTS})"""

_NOTED_ERROR = """CASE event_type WHEN 'view' THEN 'no timestamp' WHEN 'signup' THEN 'no value field'
  WHEN 'error' THEN 'field note is not a number' END"""

_LINE_SERIES = "'__name__=l_extendedprice,l_linestatus=' || l_linestatus || ',l_returnflag=' || l_returnflag"

# Milliseconds in a day and in thirty.
_DAY, _MONTH = 86_400_000, 30 * 86_400_000


def _latency(width: int) -> str:
    def at(num: int, den: int) -> str:
        return f"list_sort(list(us // 1000))[(count(*) * {num}) // {den} + 1]"

    return f"""
SELECT event_type AS key, ms // {width} * {width} AS window_start, count(*) AS count,
  CAST(sum(us) // (count(*) * 1000) AS BIGINT) AS mean_ms, min(us // 1000) AS min_ms, max(us // 1000) AS max_ms,
  {at(1, 4)} AS p25_ms, {at(1, 2)} AS p50_ms, {at(3, 4)} AS p75_ms, {at(9, 10)} AS p90_ms
FROM (SELECT event_type, (epoch_us(ts) // 1000) AS ms, CAST(round(value * 1000) AS BIGINT) AS us FROM events)
GROUP BY 1, 2"""


_PLAIN_DOUBLE = "regexp_replace(CAST({} AS VARCHAR), '\\.0$', '')"

_NAME_FORM = """(SELECT p_partkey, CASE p_type
    WHEN 'SMALL' THEN replace(p_name, ' ', '_') WHEN 'STANDARD' THEN replace(p_name, ' ', '-') END AS both_ok,
    CASE p_type WHEN 'MEDIUM' THEN replace(p_name, ' ', ':') END AS metric_only FROM part)"""

ORACLES: dict[str, str] = {
    "series_flagship": f"""
SELECT '__name__=' || name || ',event_type=' || event_type || ',user_id=' || user_id AS series, count(*) AS n,
  min(ms) AS first_ms, max(ms) AS last_ms, min(value) AS min_value, max(value) AS max_value,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total_cents
FROM {_EVENT_SAMPLES} GROUP BY 1""",
    "csv_ingest_typed": f"""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_extendedprice, l_returnflag,
  CASE WHEN l_tax <> 0 THEN l_linestatus END AS l_linestatus, (epoch_us(l_shipdate) // 1000) AS ship_ms,
  'inbound:delimited' AS inbound
FROM {_LINES} WHERE error IS NULL""",
    "csv_ingest_rejects": f"""
SELECT error, 'inbound:delimited' AS inbound, count(*) AS n FROM {_LINES} WHERE error IS NOT NULL GROUP BY error""",
    "csv_quoted_fields": """
SELECT p_partkey, replace(p_name, ' ', ',') AS p_name, p_brand, CAST(p_size AS BIGINT) AS p_size FROM part""",
    "csv_header_files": r"""
SELECT CASE WHEN c_custkey % 7 = 0 THEN '#' ELSE '' END || c_custkey AS key,
  c_name || CASE c_custkey % 5 WHEN 0 THEN chr(1) WHEN 1 THEN '\' WHEN 2 THEN 'it''s' WHEN 3 THEN '#' ELSE 'a' || chr(1) || 'b\' END AS name,
  c_acctbal AS balance, c_mktsegment AS segment FROM customer""",
    "graphite_ingest": f"""
SELECT metric, value, ts_us, 'event=' || event_id || CASE WHEN k < 10 THEN '' ELSE ',k=' || k END || ',user=' || user_attr AS attrs,
  event_id AS event FROM {_METRIC_LINES}""",
    "graphite_rejects": """
SELECT 'epoch is not 10, 13, 16 or 19 digits' AS error, count(*) AS n FROM events WHERE event_type = 'error'""",
    "graphite_samples": f"""
SELECT name, value, ts_us // 1000 AS ts_ms, 'job=bench,user=' || user_attr AS labels FROM (
  SELECT replace(metric, '.', '_') AS name, value, ts_us, user_attr FROM {_METRIC_LINES}
  UNION ALL SELECT 'event', CAST(event_id AS DOUBLE), ts_us, user_attr FROM {_METRIC_LINES}
  UNION ALL SELECT 'k', CAST(k AS DOUBLE), ts_us, user_attr FROM {_METRIC_LINES} WHERE k >= 10)""",
    "text_files_ingest": f"""
SELECT metric, count(*) AS n, max(ts_us // 1000) AS last_ms FROM {_METRIC_LINES} GROUP BY metric""",
    "cast_number_unit": """
SELECT p_partkey,
  CASE WHEN p_type IN ('ECONOMY', 'SMALL', 'PROMO') THEN CAST(p_size AS BIGINT) END AS int_value,
  CASE p_type WHEN 'SMALL' THEN 'W' WHEN 'PROMO' THEN p_brand END AS int_unit,
  CASE WHEN p_type IN ('ECONOMY', 'SMALL', 'PROMO') THEN CAST(p_size AS DOUBLE)
       WHEN p_type = 'LARGE' THEN CAST(p_size * 10 + 5 AS DOUBLE) END AS float_value,
  CASE p_type WHEN 'SMALL' THEN 'W' WHEN 'PROMO' THEN p_brand WHEN 'LARGE' THEN 'kg' END AS float_unit
FROM part""",
    "cast_bool_words": """
SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN NULL
  ELSE o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')) END AS flag FROM orders""",
    "cast_datetime_patterns": """
SELECT o_orderkey, CASE o_orderstatus || o_orderpriority
  WHEN 'O5-LOW' THEN CASE WHEN day(o_orderdate) <= 12
    THEN (epoch_us(CAST(make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) AS TIMESTAMP) + (o_orderdate - date_trunc('day', o_orderdate))) // 1000)
    ELSE (epoch_us(o_orderdate) // 1000) END
  WHEN 'P2-HIGH' THEN (epoch_us(o_orderdate) // 1000) - 8 * 3600000
  WHEN 'P3-MEDIUM' THEN (epoch_us(o_orderdate) // 1000) + 5 * 3600000
  WHEN 'F1-URGENT' THEN (epoch_us(o_orderdate) // 1000) + 400000000000
  WHEN 'F2-HIGH' THEN (epoch_us(o_orderdate) // 1000) + 400000000000
  WHEN 'F3-MEDIUM' THEN (epoch_us(o_orderdate) // 1000) + 400000000000
  WHEN 'P4-NOT SPECIFIED' THEN NULL
  WHEN 'P5-LOW' THEN (epoch_us(o_orderdate) // 1000) - 3600000
  ELSE (epoch_us(o_orderdate) // 1000) END AS ms FROM orders""",
    "label_text_render": f"""
SELECT p_partkey, {_PLAIN_DOUBLE.format("p_retailprice")} AS price, {_PLAIN_DOUBLE.format("p_retailprice * 1e6")} AS big,
  CAST(p_size AS VARCHAR) AS size, CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END AS large,
  {_PLAIN_DOUBLE.format("p_retailprice")} || ' ' || p_type AS with_unit,
  strftime(make_timestamp(p_partkey * 123000), '%Y-%m-%dT%H:%M:%S')
    || CASE WHEN p_partkey * 123 % 1000 = 0 THEN '' ELSE '.' || lpad(CAST(p_partkey * 123 % 1000 AS VARCHAR), 3, '0') END
    || '+00:00' AS stamp
FROM part""",
    "map_array_text": """
SELECT p_partkey, CASE WHEN p_type <> 'PROMO' THEN p_brand END AS brand,
  CASE WHEN p_type <> 'PROMO' THEN CAST(p_size AS VARCHAR) END AS size,
  len(string_split(p_name, ' ')) AS words, replace(p_name, ' ', '|') AS joined FROM part""",
    "sanitize_names": f"""
SELECT p_partkey, coalesce(both_ok, metric_only) AS metric, both_ok AS label FROM {_NAME_FORM}""",
    "samples_all_or_nothing": f"""
SELECT 'value' AS name, value, (epoch_us(ts) // 1000) AS ts_ms, 'event_type=' || event_type || ',user_id=' || user_id AS labels,
  'TimeseriesRecord' AS type FROM events WHERE {_NOTED_ERROR} IS NULL""",
    "sample_reject_reasons": f"""
SELECT event_type, {_NOTED_ERROR} AS error, count(*) AS n FROM events GROUP BY event_type""",
    "samples_unit_extra_labels": """
SELECT 'l_quantity' AS name, l_quantity AS value, (epoch_us(l_shipdate) // 1000) AS ts_ms,
  'job=bench,l_linestatus=fixed,l_returnflag=' || l_returnflag
    || CASE l_returnflag WHEN 'A' THEN ',unit=kg' WHEN 'N' THEN ',unit=lb' ELSE '' END AS labels FROM lineitem
UNION ALL
SELECT 'discounted', CASE WHEN l_discount > CAST(0.05 AS DOUBLE) THEN 1.0 ELSE 0.0 END, (epoch_us(l_shipdate) // 1000),
  'job=bench,l_linestatus=fixed,l_returnflag=' || l_returnflag FROM lineitem""",
    "metric_types": """
SELECT name, metric_type, status, count(*) AS n, min(v) AS least, max(v) AS greatest FROM (
  SELECT 'o_totalprice' AS name, 'counter' AS metric_type, o_orderstatus AS status, o_totalprice AS v FROM orders
  UNION ALL SELECT 'o_custkey', 'gauge', o_orderstatus, CAST(o_custkey AS DOUBLE) FROM orders
  UNION ALL SELECT 'o_orderkey', 'gauge', o_orderstatus, CAST(o_orderkey AS DOUBLE) FROM orders) GROUP BY 1, 2, 3""",
    "annotate_asof": _ANNOTATE_LINES,
    "annotate_asof_merge": _ANNOTATE_LINES,
    "annotate_delete_over_set": _ANNOTATE_EVENTS,
    "annotate_many_names": """
WITH o AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) AS us FROM orders),
per_us AS (SELECT us, count(*) AS n FROM o GROUP BY us),
l AS (SELECT *, epoch_us(l_shipdate) AS us FROM lineitem),
live AS (SELECT d.us, CAST(sum(p.n) AS BIGINT) AS n FROM (SELECT DISTINCT us FROM l) d JOIN per_us p ON p.us < d.us AND d.us <= p.us + 86400000000 GROUP BY 1),
j AS (SELECT l.*, coalesce(live.n, 0) AS n_live, coalesce(o.us < l.us, false) AS begun, coalesce(o.us < l.us AND l.us <= o.us + 86400000000, false) AS set_now, o.o_custkey
  FROM l LEFT JOIN live ON live.us = l.us LEFT JOIN o ON o.o_orderkey = l.l_orderkey)
SELECT l_orderkey, l_linenumber, l_partkey, n_live + 1 + CAST(NOT begun AS BIGINT) + CAST(NOT set_now AS BIGINT) AS n_labels,
  CASE WHEN NOT begun THEN 'x' END AS own_d, CASE WHEN set_now THEN CAST(o_custkey AS VARCHAR) ELSE 'own' END AS own_o FROM j""",
    "stream_equals_batch": f"""
WITH x AS ({_ANNOTATE_EVENTS})
SELECT *, 'out' AS sink FROM x UNION ALL SELECT name, ts_us // 1000 * 1000, cents, labels, 'copy' FROM x""",
    "series_assembled": f"""
SELECT {_LINE_SERIES} AS series, (epoch_us(l_shipdate) // 1000) // {_DAY} * {_DAY} AS chunk_ms, 0 AS part, count(*) AS n,
  string_agg((epoch_us(l_shipdate) // 1000) || ':' || CAST(round(l_extendedprice * 100) AS BIGINT), ' ' ORDER BY l_shipdate, l_extendedprice) AS samples
FROM lineitem GROUP BY 1, 2""",
    "series_hot_parts": f"""
SELECT {_LINE_SERIES} AS series, (epoch_us(l_shipdate) // 1000) // {_MONTH} * {_MONTH} AS chunk_ms, count(*) AS n, count(*) > 50 AS dealt,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, min((epoch_us(l_shipdate) // 1000)) AS first_ms, max((epoch_us(l_shipdate) // 1000)) AS last_ms, 0 AS overlaps
FROM lineitem GROUP BY 1, 2""",
    "series_rejects": f"""
SELECT CASE WHEN value = 7 THEN 'sample without name' WHEN value = 13 THEN 'sample without labels' WHEN value = 9 THEN 'sample without ts'
  WHEN value = 11 THEN 'sample without value' END AS error, count(*) AS n FROM {_EVENT_SAMPLES} GROUP BY 1""",
    "latency_summary_10s": _latency(10_000),
    "latency_summary_day": _latency(_DAY),
    "freshness_by_source": """
SELECT event_type, max((epoch_us(ts) // 1000)) AS last_ts, 1706572800000 - max((epoch_us(ts) // 1000)) AS lag_ms,
  1706572800000 - max((epoch_us(ts) // 1000)) > 1000 AS lagging FROM events GROUP BY event_type""",
    "type_filter_counts": f"""
SELECT name, 'TimeseriesRecord' AS type, count(*) AS n FROM {_EVENT_SAMPLES} GROUP BY name""",
    "fan_in_union": """
SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, 'inbound:customers' AS inbound FROM customer
UNION ALL SELECT s_name, s_acctbal, NULL, 'inbound:suppliers' FROM supplier""",
    "conform_schema": f"""
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, CAST(NULL AS BIGINT) AS o_orderstatus,
  {_PLAIN_DOUBLE.format("o_totalprice")} AS o_totalprice, (epoch_us(o_orderdate) // 1000) AS o_orderdate, o_orderpriority,
  CAST(NULL AS VARCHAR) AS o_comment, CAST(NULL AS DOUBLE) AS o_weight, TRY_CAST(o_orderkey AS SMALLINT) AS small,
  TRY_CAST(o_orderkey * 1000000 AS INTEGER) AS whole, CAST(round(CAST(round(o_totalprice * 4) / 4 AS FLOAT) * 4) AS BIGINT) AS single,
  CAST(CAST(o_totalprice AS DECIMAL(20,4)) AS DECIMAL(12,2)) AS exact, (epoch_us(o_orderdate) // 1000) AS at, CAST(NULL AS INTEGER) AS wrong FROM orders""",
    "json_records_roundtrip": f"""
SELECT event_id, event_type, CASE WHEN event_type NOT IN ('error', 'view') THEN value END AS value,
  CASE WHEN event_type <> 'error' THEN event_type = 'view' END AS infinite,
  strftime(ts, '%Y-%m-%d %H:%M:%S') || CASE WHEN us % 1000000 = 0 THEN ''
    WHEN us % 1000 = 0 THEN '.' || lpad(CAST(us % 1000000 // 1000 AS VARCHAR), 3, '0')
    ELSE '.' || lpad(CAST(us % 1000000 AS VARCHAR), 6, '0') END || ' UTC' AS ts,
  'Event' AS type FROM {_EVENTS}""",
    "json_rejects": f"""
SELECT error, count(*) AS n, CAST(sum(CASE WHEN error IS NULL THEN kk END) AS BIGINT) AS k FROM (
  SELECT CASE WHEN event_type = 'view' OR (event_type = 'click' AND k > 0) OR k % 10 = 0 THEN 'does not fit the schema' END AS error,
    CASE event_type WHEN 'error' THEN -1 ELSE k END AS kk FROM {_EVENTS}) GROUP BY 1""",
    "parquet_roundtrip": f"""
SELECT name, metric_type, ms AS ts, value, 'event_type=' || event_type || ',user_id=' || user_id AS labels FROM {_EVENT_SAMPLES}""",
    "remote_write_payload": f"""
SELECT {_LINE_SERIES} AS series, count(*) AS n, min((epoch_us(l_shipdate) // 1000)) AS first_ms, max((epoch_us(l_shipdate) // 1000)) AS last_ms,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem WHERE l_extendedprice >= 1000 GROUP BY 1""",
    "control_lines": f"""
SELECT action, name, count(*) AS n, count(value) AS with_value, max(seq) AS last_seq FROM {_ORDER_CONTROL}
WHERE name IS NOT NULL GROUP BY action, name""",
    "number_forms": """
SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) AS whole, CAST(trunc(-p_retailprice) AS BIGINT) AS negative,
  CAST(p_size AS DOUBLE) AS real, p_size || ' W' AS text FROM part""",
    "datetime_parts": """
SELECT event_id, epoch_us(ts) // 1000000 AS s, (epoch_us(ts) // 1000) AS ms, epoch_us(ts) AS us,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') AS text FROM events""",
    "map_accessors": """
SELECT (epoch_us(l_shipdate) // 1000) AS ts_ms, CAST(2 AS BIGINT) AS size, l_returnflag AS flag, false AS has_absent,
  'l_linestatus,l_returnflag' AS keys, l_linestatus AS without_flag, 'X' AS edited FROM lineitem""",
    "array_accessors": """
SELECT p_partkey, len(a) AS size, a[2] AS second, list_contains(a, 'red') AS has_red,
  CAST(coalesce(list_position(a, 'red'), 0) AS BIGINT) AS where_red,
  array_to_string(list_sort(list_append(a, p_type)), '|') AS sorted,
  array_to_string(list_concat(list_concat(a[1:1], ['new']), a[2:]), '|') AS inserted,
  array_to_string(a[2:], '|') AS removed
FROM (SELECT *, string_split(p_name, ' ') AS a FROM part)""",
    "schema_inference": """
SELECT 'OBJECT<' || string_agg(DISTINCT key || ': ' || CASE WHEN kind IN ('UBIGINT', 'BIGINT') THEN 'BIGINT' ELSE kind END, ', ') || '>' AS schema,
  CAST(0 AS BIGINT) AS nulls
FROM (SELECT key, json_type(props, '$.' || key) AS kind FROM (SELECT props, unnest(json_keys(props)) AS key FROM events))""",
}
