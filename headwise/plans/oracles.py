"""DuckDB SQL for the registered queries, written independently of the operators."""

_TABLES = """
raw AS (
  SELECT event_id AS id, ts AS observed_ts,
         CASE WHEN event_id % 11 <> 0 THEN ts + INTERVAL 60 SECOND END AS event_ts,
         event_type AS route_id, CAST(user_id AS VARCHAR) AS stop_id, value * 10 AS headway_sec
  FROM events),
means AS (SELECT route_id, round(avg(headway_sec), 6) AS mean FROM raw GROUP BY route_id),
predicted AS (
  SELECT raw.*, CASE WHEN id % 7 <> 0 THEN mean END AS predicted_headway_sec
  FROM raw JOIN means USING (route_id)),
served AS (
  SELECT *, headway_sec - predicted_headway_sec AS residual,
         CASE WHEN predicted_headway_sec IS NULL THEN 0.0
              ELSE least(1.0, abs(headway_sec - predicted_headway_sec) / 1000) END AS anomaly_score
  FROM predicted),
scored AS (SELECT * FROM served WHERE predicted_headway_sec IS NOT NULL),
week AS (SELECT * FROM served WHERE observed_ts >= (SELECT max(observed_ts) FROM raw) - INTERVAL 168 HOUR),
stops AS (
  SELECT CAST(c_custkey AS VARCHAR) AS stop_id, c_name AS stop_name,
         40.0::DOUBLE + (c_custkey % 100) / 100 AS lat, -74.0::DOUBLE + (c_custkey % 37) / 100 AS lon
  FROM customer WHERE c_custkey % 10 <> 0)
"""

_FEED = """
base AS (
  SELECT *, ['ACE','BDFM','G','JZ','NQRW','L','SI','1234567'][event_id % 8 + 1] AS feed,
         event_id % 8 + 1 AS feed_ord, date_trunc('hour', ts)::TIMESTAMP + INTERVAL 1 HOUR AS poll_ts,
         epoch_us(ts) // 1000000 + CASE WHEN event_id % 13 = 0 THEN 18000 ELSE 0 END AS t,
         CASE WHEN event_id % 17 = 0 THEN '' ELSE event_type END AS route_id
  FROM events),
flat AS (
  SELECT feed, feed_ord, poll_ts, route_id, CAST(user_id AS VARCHAR) AS stop_id,
         CASE event_id % 5 WHEN 0 THEN CASE WHEN event_id % 3 <> 0 THEN t END
                           WHEN 1 THEN t + 30 WHEN 2 THEN t WHEN 3 THEN t + 30 END AS arrival
  FROM base
  UNION ALL
  SELECT feed, feed_ord, poll_ts, route_id, CAST(user_id + 1 AS VARCHAR), t + 120
  FROM base WHERE event_id % 5 <> 0),
arrivals AS (SELECT * FROM flat WHERE route_id <> '' AND arrival IS NOT NULL),
near AS (
  SELECT * FROM arrivals
  WHERE arrival BETWEEN epoch_us(poll_ts) // 1000000 - 3600 AND epoch_us(poll_ts) // 1000000 + 14400),
earliest AS (
  SELECT poll_ts, feed, feed_ord, route_id, stop_id, min(arrival) AS arrival
  FROM near GROUP BY ALL),
lagged AS (
  SELECT *, lag(arrival) OVER (PARTITION BY route_id, stop_id ORDER BY poll_ts, feed_ord) AS prev_arrival
  FROM earliest),
headways AS (
  SELECT *, CASE WHEN arrival > prev_arrival THEN CAST(arrival - prev_arrival AS DOUBLE) END AS headway_sec
  FROM lagged)
"""

_STATS = """
hourly AS (SELECT *, CAST(hour(observed_ts) AS INTEGER) AS hour FROM raw),
stats AS (
  SELECT route_id, stop_id, hour, round(median(headway_sec), 6) AS median, round(mad(headway_sec), 6) AS mad
  FROM hourly WHERE headway_sec > 0 GROUP BY ALL)
"""

# Sequence numbers, the scorer's residual history, and the running EMA per route.
_CALIBRATION = """
numbered AS (
  SELECT id, route_id, observed_ts, abs(residual) AS x,
         row_number() OVER (PARTITION BY route_id ORDER BY observed_ts, id) - 1 AS seq
  FROM scored),
calibrated AS (
  SELECT route_id, id, seq, x, count(*) OVER history AS history_n,
         quantile_cont(x, 0.5) OVER history AS q50, quantile_cont(x, 0.9) OVER history AS q90,
         quantile_cont(x, 0.99) OVER history AS q99
  FROM numbered
  WINDOW history AS (
    PARTITION BY route_id ORDER BY seq
    ROWS BETWEEN (least(seq // 1024 * 1024, 8000) + seq % 1024) PRECEDING AND 1 PRECEDING))
"""

_EMA = """
emas AS (
  SELECT a.route_id, a.id, a.seq,
         sum(CASE WHEN b.seq = 0 THEN 1.0 ELSE 0.08 END * b.x * pow(0.92, a.seq - b.seq)) AS ema
  FROM numbered a JOIN numbered b
    ON a.route_id = b.route_id AND b.seq BETWEEN a.seq - 1024 AND a.seq
  GROUP BY ALL)
"""

_FEATURES = """
features AS (
  SELECT *, hour(observed_ts) AS h, minute(observed_ts) AS m,
         CAST(concat('0x', substr(md5(route_id), 1, 8)) AS BIGINT) % 997 / 997.0::DOUBLE AS route_hash,
         CAST(concat('0x', substr(md5(stop_id), 1, 8)) AS BIGINT) % 4093 / 4093.0::DOUBLE AS stop_hash
  FROM served),
shadow AS (
  SELECT id, route_id, stop_id, observed_ts, headway_sec, predicted_headway_sec, residual, anomaly_score AS online_score,
         sin(2 * pi() * h / 24) AS hour_sin, cos(2 * pi() * h / 24) AS hour_cos,
         sin(2 * pi() * m / 60) AS minute_sin, cos(2 * pi() * m / 60) AS minute_cos, route_hash, stop_hash
  FROM features WHERE predicted_headway_sec IS NOT NULL)
"""

_ERRORS = """
errors AS (SELECT *, (residual / 100.0) * (residual / 100.0) AS err, anomaly_score AS online_score FROM scored)
"""

_SHADOW_COLUMNS = [
    "headway_sec", "predicted_headway_sec", "residual", "online_score",
    "hour_sin", "hour_cos", "minute_sin", "minute_cos", "route_hash", "stop_hash",
]


def _with(body, *parts):
    return "WITH RECURSIVE " + ",".join([_TABLES, *parts]) + "\n" + body


def _r(expression, digits=6):
    """Rounded, with negative zero turned into zero."""
    return f"round({expression}, {digits}) + 0.0"


def _local(ts):
    return f"timezone('America/New_York', timezone('UTC', {ts}))"


def _pack(ts, prefix):
    offset = f"CAST(round((epoch_us({_local(ts)}) - epoch_us({ts})) / 60000000.0) AS INTEGER)"
    sign = f"CASE WHEN {offset} < 0 THEN '-' ELSE '+' END"
    hh = f"lpad(CAST(abs({offset}) // 60 AS VARCHAR), 2, '0')"
    mm = f"lpad(CAST(abs({offset}) % 60 AS VARCHAR), 2, '0')"
    return (
        f"strftime({ts}, '%Y-%m-%dT%H:%M:%SZ') AS {prefix}utc, "
        f"epoch_us({ts}) // 1000 AS {prefix}epoch_ms, "
        f"strftime({_local(ts)}, '%Y-%m-%dT%H:%M:%S') || {sign} || {hh} || ':' || {mm} AS {prefix}ny"
    )


_RATE = "CASE WHEN count(predicted_headway_sec) = 0 THEN 0.0 ELSE round(count(*) FILTER (predicted_headway_sec IS NOT NULL AND anomaly_score >= 0.6) / count(predicted_headway_sec) * 100.0, 2) END AS anomaly_rate_perc"
_COUNTS = (
    "count(*) FILTER (predicted_headway_sec IS NOT NULL AND anomaly_score >= 0.6) AS anomalies_count, "
    "count(*) FILTER (predicted_headway_sec IS NOT NULL AND anomaly_score >= 0.85) AS anomalies_high, "
    "count(predicted_headway_sec) AS scored_rows, " + _RATE
)
_STOPS_SEEN = "count(DISTINCT stop_id) FILTER (predicted_headway_sec IS NOT NULL) AS stations_total"
_PAIRS_SEEN = "count(DISTINCT concat(route_id, ':', stop_id)) FILTER (predicted_headway_sec IS NOT NULL AND headway_sec > 0) AS trains_active"

_WORST = "anomaly_score DESC, observed_ts DESC, id DESC"
_TOP1 = f"top1 AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY {_WORST}) = 1)"
_WEEK_TOP1 = f"top1 AS (SELECT * FROM week WHERE predicted_headway_sec IS NOT NULL QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY {_WORST}) = 1)"
_SAMPLE = "sample AS (SELECT s.* FROM shadow s JOIN week w USING (id) ORDER BY s.observed_ts DESC, id DESC LIMIT 18000)"

_FLAT_SQL = _with("SELECT feed, poll_ts, route_id, stop_id, arrival FROM arrivals", _FEED)
_HEADWAY_SQL = _with(
    "SELECT poll_ts, feed, route_id, stop_id, arrival, prev_arrival, headway_sec FROM headways", _FEED
)
_SSL = (
    "CASE WHEN x <= 0 THEN 0.0 WHEN history_n >= 64 THEN greatest(0.0, least(1.0, (x - q50) / greatest(q99 - q50, 1.0))) "
    "ELSE greatest(0.0, least(1.0, x / (3.5 * greatest(ema, 1.0)))) END"
)
_RELATIVE = "greatest(0.0, least(1.0, abs(residual) / greatest(abs(predicted_headway_sec), 120.0)))"

_CUT_SCAN = """
days AS (
  SELECT route_id, time_bucket(INTERVAL 1 DAY, observed_ts) AS bucket, count(*) AS n,
         sum(least(abs(residual) / 3600.0, 1.0)) AS s, sum(least(abs(residual) / 3600.0, 1.0) ** 2) AS ss
  FROM scored GROUP BY ALL),
sums AS (
  SELECT route_id, bucket, CAST(sum(n) OVER upto AS BIGINT) AS n0, sum(s) OVER upto AS s0,
         CAST(sum(n) OVER whole AS BIGINT) AS n, sum(s) OVER whole AS s, sum(ss) OVER whole AS ss
  FROM days
  WINDOW upto AS (PARTITION BY route_id ORDER BY bucket ROWS UNBOUNDED PRECEDING), whole AS (PARTITION BY route_id)),
tests AS (
  SELECT route_id, bucket, n0, n - n0 AS n1, s0 / n0 AS mean0, (s - s0) / (n - n0) AS mean1,
         sqrt(2 * (1.0 / n0 + 1.0 / (n - n0)) * greatest(ss / n - (s / n) * (s / n), 0) * ln(2 * n / 0.002))
           + 2.0 / 3.0 * (1.0 / n0 + 1.0 / (n - n0)) * ln(2 * n / 0.002) AS epsilon
  FROM sums WHERE n0 < n)
"""

# Recursion over the rows of each route: running standardisation and PA-I regression.
_REGRESSION = """
usable AS (
  SELECT id, route_id, headway_sec AS y, h, route_hash, stop_hash, observed_ts,
         row_number() OVER (PARTITION BY route_id ORDER BY observed_ts, id) - 1 AS seq
  FROM features WHERE headway_sec > 0),
steps AS (
  SELECT route_id, CAST(-1 AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS id, CAST(NULL AS DOUBLE) AS y,
         CAST(NULL AS DOUBLE) AS guess, 0 AS n, [0.0, 0.0, 0.0]::DOUBLE[] AS m, [0.0, 0.0, 0.0]::DOUBLE[] AS s,
         [0.0, 0.0, 0.0]::DOUBLE[] AS w, CAST(0 AS DOUBLE) AS b
  FROM (SELECT DISTINCT route_id FROM usable)
  UNION ALL
  SELECT route_id, seq, id, y, guess, n, m, s,
         [w[1] + step * z[1], w[2] + step * z[2], w[3] + step * z[3]], b + step
  FROM (
    SELECT *, sign(e) * CASE WHEN norm > 0 THEN least(1.0, greatest(0.0, abs(e) - 0.1) / norm)
                             ELSE least(1.0, greatest(0.0, abs(e) - 0.1)) END AS step
    FROM (
      SELECT *, y - (b + (w[1] * z[1] + w[2] * z[2] + w[3] * z[3])) AS e,
             z[1] * z[1] + z[2] * z[2] + z[3] * z[3] AS norm
      FROM (
        SELECT *, [CASE WHEN s[1] > 0 THEN (x[1] - m[1]) / sqrt(s[1] / n) ELSE 0.0 END,
                   CASE WHEN s[2] > 0 THEN (x[2] - m[2]) / sqrt(s[2] / n) ELSE 0.0 END,
                   CASE WHEN s[3] > 0 THEN (x[3] - m[3]) / sqrt(s[3] / n) ELSE 0.0 END] AS z
        FROM (
          SELECT route_id, seq, id, y, x, CASE WHEN raw_guess = 0 THEN y ELSE raw_guess END AS guess, n, m, w, b,
                 [s[1] + (x[1] - old[1]) * (x[1] - m[1]), s[2] + (x[2] - old[2]) * (x[2] - m[2]),
                  s[3] + (x[3] - old[3]) * (x[3] - m[3])] AS s
          FROM (
            SELECT u.route_id, u.seq, u.id, u.y, u.x, p.n + 1 AS n, p.m AS old, p.s, p.w, p.b,
                   [p.m[1] + (u.x[1] - p.m[1]) / (p.n + 1), p.m[2] + (u.x[2] - p.m[2]) / (p.n + 1),
                    p.m[3] + (u.x[3] - p.m[3]) / (p.n + 1)] AS m,
                   p.b + CASE WHEN p.s[1] > 0 THEN p.w[1] * ((u.x[1] - p.m[1]) / sqrt(p.s[1] / p.n)) ELSE 0.0 END
                       + CASE WHEN p.s[2] > 0 THEN p.w[2] * ((u.x[2] - p.m[2]) / sqrt(p.s[2] / p.n)) ELSE 0.0 END
                       + CASE WHEN p.s[3] > 0 THEN p.w[3] * ((u.x[3] - p.m[3]) / sqrt(p.s[3] / p.n)) ELSE 0.0 END AS raw_guess
            FROM steps p JOIN (SELECT *, [h, route_hash, stop_hash]::DOUBLE[] AS x FROM usable) u
              ON u.route_id = p.route_id AND u.seq = p.seq + 1)))))),
learned AS (
  SELECT s.route_id, s.seq, s.id, guess AS predicted_headway_sec, s.y - guess AS residual, h, observed_ts
  FROM steps s JOIN usable u ON s.id = u.id WHERE s.seq >= 0)
"""

# Half-space trees over the points (route_id, seq, id, residual, h), block of 250 rows by block.
_TREES = """
centres AS (
  SELECT t, a, CAST(concat('0x', substr(md5(concat('42:centre:', t, ':', a)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS c
  FROM range(10) r(t), range(2) q(a)),
nodes AS (
  SELECT x.t, CAST(0 AS BIGINT) AS node, 0 AS depth,
         x.c - 2 * greatest(x.c, 1 - x.c) AS low0, x.c + 2 * greatest(x.c, 1 - x.c) AS high0,
         y.c - 2 * greatest(y.c, 1 - y.c) AS low1, y.c + 2 * greatest(y.c, 1 - y.c) AS high1
  FROM centres x JOIN centres y ON x.t = y.t AND x.a = 0 AND y.a = 1
  UNION ALL
  SELECT t, 2 * node + 1 + side, depth + 1,
         CASE WHEN a = 0 AND side = 1 THEN cut ELSE low0 END, CASE WHEN a = 0 AND side = 0 THEN cut ELSE high0 END,
         CASE WHEN a = 1 AND side = 1 THEN cut ELSE low1 END, CASE WHEN a = 1 AND side = 0 THEN cut ELSE high1 END
  FROM (SELECT *, CASE a WHEN 0 THEN (low0 + high0) / 2 ELSE (low1 + high1) / 2 END AS cut
        FROM (SELECT *, CAST(concat('0x', substr(md5(concat('42:split:', t, ':', node)), 1, 8)) AS BIGINT) % 2 AS a FROM nodes)),
       (SELECT unnest([0, 1]) AS side)
  WHERE depth < 8),
splits AS (
  SELECT t, node, CAST(concat('0x', substr(md5(concat('42:split:', t, ':', node)), 1, 8)) AS BIGINT) % 2 AS a,
         (low0 + high0) / 2 AS cut0, (low1 + high1) / 2 AS cut1
  FROM nodes WHERE depth < 8),
walks AS (
  SELECT route_id, seq, id, greatest(0.0, least(1.0, residual / 7200.0 + 0.5)) AS px, h / 24.0::DOUBLE AS py,
         t, CAST(0 AS BIGINT) AS node, 0 AS depth
  FROM points, range(10) r(t)
  UNION ALL
  SELECT route_id, seq, id, px, py, w.t,
         2 * w.node + 1 + CASE WHEN a = 0 THEN CAST(px >= cut0 AS INT) ELSE CAST(py >= cut1 AS INT) END, depth + 1
  FROM walks w JOIN splits s ON w.t = s.t AND w.node = s.node),
masses AS (SELECT route_id, seq // 250 AS block, t, node, count(*) AS mass FROM walks GROUP BY ALL),
seen AS (
  SELECT w.*, coalesce(mass, 0) AS mass
  FROM walks w LEFT JOIN masses m
    ON m.route_id = w.route_id AND m.block = w.seq // 250 - 1 AND m.t = w.t AND m.node = w.node),
tree_scores AS (
  SELECT id, CASE WHEN seq < 250 THEN 0.0 ELSE 1 - sum(mass * 2 ** depth) / (10 * 250 * 511.0) END AS tree_score
  FROM (SELECT *, min(CASE WHEN mass < 25 THEN depth ELSE 8 END) OVER (PARTITION BY id, t) AS stop FROM seen)
  WHERE depth <= stop GROUP BY id, seq)
"""

_LEARNED_POINTS = "points AS (SELECT route_id, seq, id, residual, h FROM learned)"

# The whole scorer, for data without drift: none of the test tables contains one,
# so nothing is reset. The residual history and the EMA run over learned residuals.
_SCORER = [
    _FEATURES, _REGRESSION, _LEARNED_POINTS, _TREES,
    "numbered AS (SELECT id, route_id, observed_ts, abs(residual) AS x, seq FROM learned)",
    _CALIBRATION[_CALIBRATION.index("calibrated AS"):], _EMA,
    f"""scorer AS (
  SELECT l.id, l.route_id, l.seq, l.observed_ts, predicted_headway_sec, residual, ema, history_n, q90, q99, tree_score,
         {_SSL} AS ssl_score, {_RELATIVE} AS relative_error,
         greatest(0.0, least(1.0, 0.50 * {_SSL} + 0.30 * tree_score + 0.20 * {_RELATIVE})) AS anomaly_score
  FROM learned l JOIN calibrated c USING (id) JOIN emas e USING (id) JOIN tree_scores USING (id))""",
]

_ONLINE_TELEMETRY = f"""
SELECT count(*) AS rows_seen, count(*) AS rows_updated, CAST(0 AS BIGINT) AS drift_events,
  {_r('arg_max(ema, (observed_ts, id))', 4)} AS mae_ema,
  {_r('arg_max(q90, (observed_ts, id)) FILTER (q90 > 0 AND history_n >= 64 AND residual <> 0)', 4)} AS residual_q90,
  {_r('arg_max(q99, (observed_ts, id)) FILTER (q99 > 0 AND history_n >= 64 AND residual <> 0)', 4)} AS residual_q99,
  (count(*) - 1) % 1024 + 1 AS last_batch_processed,
  (SELECT count(*) FROM raw WHERE headway_sec IS NOT NULL AND id NOT IN (SELECT id FROM scorer)) AS unscored_backlog,
  strftime((SELECT max(observed_ts) FROM raw), '%Y-%m-%dT%H:%M:%SZ') AS last_run_utc
FROM scorer"""

ORACLES = {
    # Sources and sinks
    "feed_flatten": _FLAT_SQL,
    "feed_union": _FLAT_SQL,
    "feed_stream_source": _FLAT_SQL,
    "scores_append": _with(
        """SELECT row_number() OVER (ORDER BY poll_ts, feed_ord, route_id, stop_id) - 1 AS id,
             poll_ts AS observed_ts, make_timestamp(arrival * 1000000) AS event_ts, route_id, stop_id, headway_sec,
             CAST(NULL AS DOUBLE) AS predicted_headway_sec, CAST(0.0 AS DOUBLE) AS anomaly_score,
             CAST(NULL AS DOUBLE) AS residual, 300 AS window_sec, strftime(poll_ts, '%Y-%m-%d') AS observed_date
           FROM headways""", _FEED),
    "scores_update": _with(
        """SELECT id, predicted_headway_sec, residual, anomaly_score,
             CASE WHEN predicted_headway_sec IS NOT NULL
                  THEN CASE WHEN id % 3 = 1 THEN 200 ELSE 300 END
                  ELSE CASE id % 3 WHEN 0 THEN 0 WHEN 1 THEN 200 END END AS window_sec
           FROM served"""),
    "stops_load": """SELECT CAST(c_custkey AS VARCHAR) AS stop_id, 'The "' || c_name || '", stop' AS stop_name,
             40.0::DOUBLE + (c_custkey % 100) / 100 AS lat, -74.0::DOUBLE + (c_custkey % 37) / 100 AS lon, 0 AS n_routes
           FROM customer WHERE c_custkey % 5 <> 0""",
    "routes_static_load": "SELECT DISTINCT c_mktsegment AS route_id FROM customer WHERE c_custkey % 7 <> 0",
    "telemetry_read": _with(
        """SELECT 'good' AS document, 'available' AS status, count(*) AS rows_seen, max(id) AS rows_updated,
             max(headway_sec) AS mae_ema, CAST(NULL AS VARCHAR) AS last_run_utc FROM raw
           UNION ALL SELECT 'broken', 'error', NULL, NULL, NULL, NULL
           UNION ALL SELECT 'list', 'unavailable', NULL, NULL, NULL, NULL
           UNION ALL SELECT 'missing', 'unavailable', NULL, NULL, NULL, NULL"""),
    "telemetry_write": _with("SELECT 'available' AS status, * FROM (" + _ONLINE_TELEMETRY + ")", *_SCORER),
    "model_state_io": _with(
        f"""SELECT route_id, count(*) AS rows_seen, {_r('arg_max(ema, seq)', 4)} AS mae_ema, CAST(0 AS BIGINT) AS drift_events,
             '20240201000000' AS version FROM scorer GROUP BY route_id""", *_SCORER),
    # Filters
    "arrival_horizon_filter": _with("SELECT feed, poll_ts, route_id, stop_id, arrival FROM near", _FEED),
    "recent_window_filter": _with("SELECT id, observed_ts, route_id FROM week"),
    "route_filter": _with("SELECT id, route_id, stop_id FROM raw WHERE route_id = 'purchase'"),
    "min_score_filter": _with("SELECT id, anomaly_score FROM served WHERE anomaly_score >= 0.6"),
    "scored_unscored_split": _with(
        "SELECT id, CASE WHEN predicted_headway_sec IS NULL THEN 'unscored' ELSE 'scored' END AS part FROM served"),
    "positive_headway": _with("SELECT id, headway_sec FROM raw WHERE headway_sec > 0 AND id % 9 <> 0"),
    "severity_flags": _with(
        "SELECT id, anomaly_score >= 0.6 AS is_anomaly, anomaly_score >= 0.85 AS is_high FROM served"),
    "severity_band": _with(
        """SELECT CASE WHEN anomaly_score < 0.35 THEN 'low' WHEN anomaly_score < 0.6 THEN 'watch'
                    WHEN anomaly_score < 0.85 THEN 'elevated' ELSE 'critical' END AS band,
             count(*) AS n, min(anomaly_score) AS min_score, max(anomaly_score) AS max_score
           FROM served GROUP BY band"""),
    # Joins
    "features_join_stats": _with(
        "SELECT id, hour, round(headway_sec, 6) AS headway_sec, median, mad FROM hourly LEFT JOIN stats USING (route_id, stop_id, hour)", _STATS),
    "stop_name_left_join": _with("SELECT id, stop_id, stop_name FROM raw LEFT JOIN stops USING (stop_id)"),
    "stop_geo_inner_join": _with("SELECT id, stop_id, stop_name, lat, lon FROM raw JOIN stops USING (stop_id)"),
    "last_seen_lookup": _with(
        """SELECT poll_ts, feed, route_id, stop_id, arrival,
             (SELECT arg_max(p.arrival, (p.poll_ts, p.feed_ord)) FROM earliest p
              WHERE p.route_id = e.route_id AND p.stop_id = e.stop_id AND p.poll_ts < middle.cut) AS prev_arrival
           FROM earliest e, (SELECT make_timestamp((epoch_us(min(poll_ts)) // 1000000 + epoch_us(max(poll_ts)) // 1000000) // 2 * 1000000) AS cut
                             FROM earliest) middle
           WHERE poll_ts >= middle.cut""", _FEED),
    # Aggregates
    "earliest_arrival": _with("SELECT poll_ts, feed, route_id, stop_id, arrival FROM earliest", _FEED),
    "headway_median_mad": _with("SELECT * FROM stats", _STATS),
    "count_scored": _with("SELECT count(predicted_headway_sec) AS scored_rows FROM week"),
    "count_distinct_stops": _with(f"SELECT {_STOPS_SEEN} FROM week"),
    "count_distinct_route_stop": _with(f"SELECT {_PAIRS_SEEN} FROM week"),
    "conditional_counts": _with(f"SELECT {_COUNTS} FROM week"),
    "max_observed": _with("SELECT max(observed_ts) AS last_observed FROM raw"),
    "unscored_backlog": _with("SELECT count(*) AS unscored_backlog FROM served WHERE predicted_headway_sec IS NULL"),
    "readiness_counts": _with(
        "SELECT count(*) AS scores_total, count(headway_sec) AS headway_ready, count(predicted_headway_sec) AS scored_rows FROM served"),
    "error_quantiles": _with(
        f"""SELECT {_r('p90')} AS recon_error_p90, {_r('p99')} AS recon_error_p99, {_r('max(err)')} AS recon_error_max,
             count(*) FILTER (err >= p99) AS shadow_alerts_high
           FROM errors, (SELECT quantile_cont(err, 0.9) AS p90, quantile_cont(err, 0.99) AS p99 FROM errors)
           GROUP BY p90, p99""", _ERRORS),
    "score_correlation": _with(f"SELECT {_r('corr(err, online_score)')} AS corr_with_online_score FROM errors", _ERRORS),
    "distinct_routes": _with(
        "SELECT DISTINCT route_id FROM raw WHERE observed_ts >= (SELECT max(observed_ts) FROM raw) - INTERVAL 24 HOUR"),
    # Windows
    "headway_lag": _HEADWAY_SQL,
    "top1_per_stop": _with("SELECT stop_id, id, route_id, observed_ts, anomaly_score FROM top1", _TOP1),
    "residual_quantiles": _with(
        "SELECT route_id, id, seq, history_n, " + ", ".join(f"{_r(q, 4)} AS {q}" for q in ("q50", "q90", "q99"))
        + " FROM calibrated", _CALIBRATION),
    "ema_scale": _with(f"SELECT route_id, id, seq, {_r('ema', 3)} AS ema FROM emas", _CALIBRATION, _EMA),
    # Ranking
    "top_anomalies": _with(
        f"SELECT id, route_id, stop_id, observed_ts, anomaly_score FROM scored ORDER BY {_WORST} LIMIT 1000"),
    "fifo_unscored_batch": _with(
        """SELECT id, route_id, stop_id, CAST(hour(observed_ts) AS INTEGER) AS hour, headway_sec FROM served
           WHERE predicted_headway_sec IS NULL AND headway_sec > 0 ORDER BY observed_ts, id LIMIT 1024"""),
    "recent_scored_sample": _with(
        """SELECT id, observed_ts, headway_sec, predicted_headway_sec FROM week WHERE predicted_headway_sec IS NOT NULL
           ORDER BY observed_ts DESC, id DESC LIMIT 18000"""),
    "top_error_events": _with(
        f"""SELECT route_id, stop_id, stop_id AS stop_name, {_r('err')} AS dl_error, {_r('online_score')} AS online_score
           FROM errors ORDER BY err DESC, id DESC LIMIT 5""", _ERRORS),
    "anomaly_page": _with(
        f"SELECT id, stop_id, anomaly_score FROM scored ORDER BY {_WORST} LIMIT 20 OFFSET 40"),
    # Scalar functions
    "ts_pack": _with(
        f"SELECT id, {_pack('observed_ts', 'observed_ts_')}, {_pack('event_ts', 'event_ts_')} FROM raw"),
    "hour_utc": _with(
        "SELECT id, CAST(hour(observed_ts) AS INTEGER) AS hour, CAST(minute(observed_ts) AS INTEGER) AS minute FROM raw"),
    "cyclic_time": _with(
        f"""SELECT id, {_r('sin(2 * pi() * hour(observed_ts) / 24)')} AS hour_sin,
             {_r('cos(2 * pi() * hour(observed_ts) / 24)')} AS hour_cos,
             {_r('sin(2 * pi() * minute(observed_ts) / 60)')} AS minute_sin,
             {_r('cos(2 * pi() * minute(observed_ts) / 60)')} AS minute_cos FROM raw"""),
    "stable_hash_unit": _with(
        "SELECT id, route_hash, CASE WHEN id % 10 = 0 THEN 0.0 ELSE stop_hash END AS stop_hash FROM features", _FEATURES),
    "clip01": _with("SELECT id, CASE WHEN residual IS NOT NULL THEN greatest(0.0, least(1.0, residual / 100)) END AS clipped FROM served"),
    "relative_error": _with(f"SELECT id, {_RELATIVE} AS relative_error FROM scored"),
    "ssl_residual_score": _with(
        f"SELECT c.id, c.seq, {_r(_SSL)} AS ssl_score FROM calibrated c JOIN emas e USING (id)", _CALIBRATION, _EMA),
    "composite_score": _with(
        f"""SELECT id, greatest(0.0, least(1.0, 0.50 * anomaly_score + 0.30 * least(1.0, headway_sec / 2000)
             + 0.20 * {_RELATIVE})) AS composite FROM scored"""),
    "geojson_features": _with(
        """SELECT stop_id, 'Point' AS geometry, lon, lat, anomaly_score, headway_sec,
             epoch_us(observed_ts) // 1000 AS observed_ts_epoch_ms, event_ts IS NOT NULL AS has_event
           FROM top1 JOIN stops USING (stop_id)""", _TOP1),
    "set_fingerprint": _with(
        """SELECT CAST(sum(n) AS BIGINT) AS n, substr(sha1(string_agg(bucket || ':' || digest, ',' ORDER BY bucket)), 1, 16) AS fingerprint
           FROM (SELECT substr(md5(stop_id), 1, 2) AS bucket, count(*) AS n,
                        sha1(string_agg(stop_id, ',' ORDER BY stop_id)) AS digest FROM stops GROUP BY 1)"""),
    # Streaming
    "stream_headway": _HEADWAY_SQL,
    "stream_score": _with(
        "SELECT id, route_id, seq, " + ", ".join(
            f"{_r(c, 4)} AS {c}" for c in ("predicted_headway_sec", "residual", "anomaly_score")) + " FROM scorer", *_SCORER),
    "stream_enrich": _with("SELECT id, route_id, stop_id, headway_sec, stop_name FROM raw LEFT JOIN stops USING (stop_id)"),
    "stream_window_summary": _with(
        """SELECT s AS window_start, s + INTERVAL 15 MINUTE AS window_end,
             count(predicted_headway_sec) AS scored_rows,
             count(*) FILTER (predicted_headway_sec IS NOT NULL AND anomaly_score >= 0.6) AS anomalies_count,
             count(*) FILTER (predicted_headway_sec IS NOT NULL AND anomaly_score >= 0.85) AS anomalies_high,
             count(DISTINCT stop_id) FILTER (predicted_headway_sec IS NOT NULL) AS stations_total,
             count(DISTINCT concat(route_id, ':', stop_id))
               FILTER (predicted_headway_sec IS NOT NULL AND headway_sec > 0) AS trains_active,
             CASE WHEN count(predicted_headway_sec) > 0 THEN round(
               count(*) FILTER (predicted_headway_sec IS NOT NULL AND anomaly_score >= 0.6) / count(predicted_headway_sec) * 100.0, 2)
               ELSE 0.0 END AS anomaly_rate_perc
           FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, observed_ts) - to_minutes(unnest([0, 5, 10])) AS s FROM served)
           GROUP BY s"""),
    # Learners
    "online_features": _with("SELECT id, CAST(h AS DOUBLE) AS hour, route_hash, stop_hash FROM features", _FEATURES),
    "online_headway_regression": _with(
        f"""SELECT id, route_id, seq, {_r('predicted_headway_sec', 4)} AS predicted_headway_sec,
             {_r('residual', 4)} AS residual FROM learned""", _FEATURES, _REGRESSION),
    "half_space_trees": _with(
        f"SELECT id, route_id, seq, {_r('tree_score')} AS tree_score FROM points JOIN tree_scores USING (id)",
        """points AS (
          SELECT id, route_id, residual, hour(observed_ts) AS h,
                 row_number() OVER (PARTITION BY route_id ORDER BY observed_ts, id) - 1 AS seq
          FROM scored)""", _TREES),
    "score_online": _with(
        "SELECT id, route_id, seq, " + ", ".join(f"{_r(c, 4)} AS {c}" for c in (
            "predicted_headway_sec", "residual", "ema", "ssl_score", "tree_score", "relative_error", "anomaly_score"))
        + ", false AS drifted FROM scorer", *_SCORER),
    "telemetry_online": _with(_ONLINE_TELEMETRY, *_SCORER),
    "drift_cut_scan": _with(
        f"""SELECT route_id, bucket, n0, n1, {_r('mean0')} AS mean0, {_r('mean1')} AS mean1, {_r('epsilon')} AS epsilon,
             abs(mean0 - mean1) >= epsilon AS is_cut FROM tests""", _CUT_SCAN),
    "standardise_matrix": _with(
        "SELECT id, " + ", ".join(
            _r(f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () < 1e-6 THEN 1 ELSE stddev_pop({c}) OVER () END", 5)
            + f" AS {c}" for c in _SHADOW_COLUMNS) + " FROM shadow", _FEATURES),
    # Served queries
    "q_summary": _with(
        f"""SELECT '168h' AS "window", {_STOPS_SEEN}, {_PAIRS_SEEN}, {_COUNTS},
             {_pack('(SELECT max(observed_ts) FROM raw)', 'last_updated_')} FROM week"""),
    "q_anomalies": _with(
        f"""SELECT route_id, stop_id, stop_name, headway_sec, predicted_headway_sec, anomaly_score, residual,
             {_pack('observed_ts', 'observed_ts_')}, {_pack('event_ts', 'event_ts_')}
           FROM (SELECT * FROM week WHERE predicted_headway_sec IS NOT NULL AND anomaly_score >= 0.2
                 ORDER BY {_WORST} LIMIT 400) LEFT JOIN stops USING (stop_id)"""),
    "q_heatmap": _with(
        f"""SELECT stop_id, stop_name, route_id, lon, lat, anomaly_score, residual, headway_sec, predicted_headway_sec,
             {_pack('observed_ts', 'observed_ts_')}, {_pack('event_ts', 'event_ts_')}
           FROM top1 JOIN stops USING (stop_id)""", _WEEK_TOP1),
    "q_routes": _with(
        "SELECT DISTINCT route_id FROM raw WHERE observed_ts >= (SELECT max(observed_ts) FROM raw) - INTERVAL 24 HOUR"),
    "q_stops": _with("SELECT stop_id, stop_name, lat, lon, 0 AS n_routes FROM stops"),
    "q_freshness": _with(
        f"""SELECT 'ok' AS status, count(*) AS scores_total,
             count(*) FILTER (observed_ts >= (SELECT max(observed_ts) FROM raw) - INTERVAL 5 MINUTE) AS scores_recent_15m,
             {_pack('(SELECT max(observed_ts) FROM raw)', 'last_observed_ts_')},
             CAST(600 AS BIGINT) AS last_observed_age_sec, true AS fresh, (SELECT count(*) FROM stops) AS stops_count,
             'available' AS model_status, 'unavailable' AS shadow_status,
             '{{"rows_seen":' || count(*) || ',"rows_updated":' || max(id) || '}}' AS model_telemetry,
             CAST(NULL AS VARCHAR) AS shadow_telemetry FROM served"""),
    "telemetry_read_all": _with(
        """SELECT 'model' AS document_name, 'available' AS status,
             '{"rows_seen":' || count(*) || ',"rows_updated":' || max(id) || '}' AS document FROM raw
           UNION ALL SELECT 'shadow', 'unavailable', NULL"""),
    "routes_fingerprint": _with(
        """SELECT CAST(sum(n) AS BIGINT) AS n, substr(sha1(string_agg(bucket || ':' || digest, ',' ORDER BY bucket)), 1, 16) AS fingerprint
           FROM (SELECT substr(md5(route_id), 1, 2) AS bucket, count(*) AS n,
                        sha1(string_agg(route_id, ',' ORDER BY route_id)) AS digest
                 FROM (SELECT DISTINCT route_id FROM raw
                       WHERE observed_ts >= (SELECT max(observed_ts) FROM raw) - INTERVAL 24 HOUR) GROUP BY 1)"""),
    "station_layer": _with("SELECT stop_id, stop_name, lon, lat FROM stops"),
    "heatmap_collection": _with(
        f"""SELECT 'FeatureCollection' AS type, strftime((SELECT max(observed_ts) FROM raw), '%Y-%m-%dT%H:%M:%SZ') AS timestamp,
             lon, lat, stop_id, stop_name, route_id, coalesce(anomaly_score, 0.0) AS anomaly_score, coalesce(residual, 0.0) AS residual,
             headway_sec, predicted_headway_sec, observed_ts_utc, event_ts_utc
           FROM (SELECT *, {_pack('observed_ts', 'observed_ts_')}, {_pack('event_ts', 'event_ts_')} FROM top1 JOIN stops USING (stop_id))""", _WEEK_TOP1),
    "rewrite_scores": _with(
        """SELECT id, CASE WHEN fresh THEN predicted_headway_sec END AS predicted_headway_sec,
             CASE WHEN fresh THEN residual END AS residual, CASE WHEN fresh THEN anomaly_score ELSE 0.0 END AS anomaly_score
           FROM (SELECT *, predicted_headway_sec IS NOT NULL
                   AND observed_ts >= (SELECT max(observed_ts) FROM raw) - INTERVAL 24 HOUR AS fresh FROM served)"""),
    "score_cycle": _with(
        "SELECT id, " + ", ".join(f"{_r(c, 4)} AS {c}" for c in ("predicted_headway_sec", "residual", "anomaly_score"))
        + """ FROM scorer WHERE id IN (SELECT id FROM raw WHERE headway_sec > 0 ORDER BY observed_ts, id LIMIT 4096)""", *_SCORER),
    "q_features_batch": _with(
        """, recent AS (SELECT id, route_id, stop_id, hour(observed_ts) AS h, headway_sec FROM week WHERE headway_sec > 0),
           grouped AS (SELECT route_id, stop_id, h, median(headway_sec) AS median, mad(headway_sec) AS mad FROM recent GROUP BY ALL)
           SELECT id, route_id, stop_id, CAST(h AS INTEGER) AS hour, round(headway_sec, 6) AS headway_sec, round(median, 6) AS median, round(mad, 6) AS mad
           FROM recent JOIN grouped USING (route_id, stop_id, h)"""),
    "q_shadow_features": _with(
        "SELECT id, route_id, stop_id, " + ", ".join(f"{_r(c)} AS {c}" for c in _SHADOW_COLUMNS) + " FROM sample",
        _FEATURES, _SAMPLE),
}
