"""The registered queries as plain SQL over the same tables, written independently."""

from __future__ import annotations

import re

# Each entry is one common table expression; later ones build on earlier ones.
_CTES = {
    "trips_fx": """
  SELECT event_id AS trip_id, user_id AS scooter_id, city, ts0,
    CASE city WHEN 'a' THEN strftime(ts0, '%Y-%m-%dT%H:%M:%SZ')
              WHEN 'b' THEN strftime(ts0, '%m/%d/%YT%H:%M:%S')
              ELSE strftime(ts0, '%Y-%m-%dT%H:%M') END AS start_time_utc,
    CASE city WHEN 'a' THEN strftime(ts1, '%Y-%m-%dT%H:%M:%SZ')
              WHEN 'b' THEN strftime(ts1, '%m/%d/%YT%H:%M:%S')
              ELSE strftime(ts1, '%Y-%m-%dT%H:%M') END AS end_time_utc,
    39.70e0 + ((event_id * 7919) % 400) / 10000e0 + 3e-5
      + CASE WHEN event_id % 500 = 3 THEN 5e0 ELSE 0e0 END AS start_lat,
    -86.30e0 + ((event_id * 104729) % 600) / 10000e0 + 3e-5 AS start_lon,
    CASE WHEN event_id % 211 <> 5
      THEN 39.70e0 + ((event_id * 15485863) % 400) / 10000e0 + 3e-5 END AS end_lat,
    -86.30e0 + ((event_id * 32452843) % 600) / 10000e0 + 3e-5
      + CASE WHEN event_id % 700 = 9 THEN 7e0 ELSE 0e0 END AS end_lon,
    CASE WHEN event_id % 97 = 0 THEN 0e0 ELSE value END AS distance_miles
  FROM (SELECT *, moved + to_minutes(event_id % 50) AS ts1, moved AS ts0,
          CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS city
        FROM (SELECT *, date_trunc('second', ts) + to_hours(
            CASE WHEN epoch(date_trunc('second', ts))::BIGINT // 3600 % 29 IN (7, 8) THEN 2 ELSE 0 END) AS moved
          FROM events))""",
    "typed": """
  SELECT * REPLACE (
    CASE city WHEN 'a' THEN try_strptime(start_time_utc, '%Y-%m-%dT%H:%M:%SZ')
              WHEN 'b' THEN try_strptime(start_time_utc, '%m/%d/%YT%H:%M:%S')
              ELSE try_strptime(start_time_utc, '%Y-%m-%dT%H:%M') END AS start_time_utc,
    CASE city WHEN 'a' THEN try_strptime(end_time_utc, '%Y-%m-%dT%H:%M:%SZ')
              WHEN 'b' THEN try_strptime(end_time_utc, '%m/%d/%YT%H:%M:%S')
              ELSE try_strptime(end_time_utc, '%Y-%m-%dT%H:%M') END AS end_time_utc)
  FROM trips_fx""",
    "whole": """
  SELECT * FROM typed
  WHERE distance_miles <> 0 AND end_lat IS NOT NULL AND scooter_id IS NOT NULL
    AND start_time_utc IS NOT NULL AND end_time_utc IS NOT NULL""",
    "lon_stats": """
  SELECT city, avg(v) AS mean, stddev_pop(v) AS std
  FROM (SELECT city, start_lon AS v FROM whole UNION ALL SELECT city, end_lon FROM whole)
  GROUP BY city""",
    "near_lon": """
  SELECT w.* FROM whole w JOIN lon_stats s USING (city)
  WHERE abs((start_lon - mean) / std) < 3 AND abs((end_lon - mean) / std) < 3""",
    "lat_stats": """
  SELECT city, avg(v) AS mean, stddev_pop(v) AS std
  FROM (SELECT city, start_lat AS v FROM near_lon UNION ALL SELECT city, end_lat FROM near_lon)
  GROUP BY city""",
    "clean": """
  SELECT w.* FROM near_lon w JOIN lat_stats s USING (city)
  WHERE abs((start_lat - mean) / std) < 3 AND abs((end_lat - mean) / std) < 3""",
    "box": """
  SELECT city, min(least(start_lat, end_lat)) AS min_lat, min(least(start_lon, end_lon)) AS min_lon,
    max(greatest(start_lat, end_lat)) AS max_lat, max(greatest(start_lon, end_lon)) AS max_lon
  FROM clean GROUP BY city""",
    "tagged": """
  SELECT *, epoch(start_time_utc)::BIGINT // 3600 AS h0, epoch(end_time_utc)::BIGINT // 3600 AS h1
  FROM clean""",
    "span": "SELECT city, min(h0) AS first_hour, max(h0) AS last_hour FROM tagged GROUP BY city",
    "gridded": """
  SELECT t.trip_id, t.city, h0 - first_hour AS start_hour, h1 - first_hour AS end_hour,
    trunc((start_lon - min_lon) * 40000000e0 * cos((min_lat + start_lat) * pi() / 360e0) / 360e0 / 250e0)::INTEGER AS start_x,
    trunc((start_lat - min_lat) * 40000000e0 / 360e0 / 250e0)::INTEGER AS start_y,
    trunc((end_lon - min_lon) * 40000000e0 * cos((min_lat + end_lat) * pi() / 360e0) / 360e0 / 250e0)::INTEGER AS end_x,
    trunc((end_lat - min_lat) * 40000000e0 / 360e0 / 250e0)::INTEGER AS end_y
  FROM tagged t JOIN box USING (city) JOIN span USING (city)""",
    "ends": """
  SELECT city, trip_id, start_hour, end_hour, 0 AS channel, start_x AS x, start_y AS y FROM gridded
  UNION ALL
  SELECT city, trip_id, start_hour, end_hour, 1, end_x, end_y FROM gridded""",
    "demand": """
  SELECT city, start_hour AS hour, channel, x, y, count(*) AS cnt FROM ends GROUP BY ALL""",
    "hours": """
  SELECT city, unnest(range(0, last_hour - first_hour)) AS hour,
    last_hour - first_hour AS n, first_hour FROM span""",
    "filled": """
  SELECT h.city, h.hour, channel, x, y, coalesce(cnt, 0) AS cnt
  FROM hours h LEFT JOIN demand d ON d.city = h.city AND d.hour = h.hour""",
    "visits": "SELECT city, x, y, count(*) AS visits FROM ends GROUP BY ALL",
    "x_axis": "SELECT city, x, row_number() OVER (PARTITION BY city ORDER BY x) - 1 AS x_idx FROM (SELECT DISTINCT city, x FROM ends)",
    "y_axis": "SELECT city, y, row_number() OVER (PARTITION BY city ORDER BY y) - 1 AS y_idx FROM (SELECT DISTINCT city, y FROM ends)",
    "dims": """
  SELECT city, nx, ny FROM (SELECT city, count(*) AS nx FROM x_axis GROUP BY city)
  JOIN (SELECT city, count(*) AS ny FROM y_axis GROUP BY city) USING (city)""",
    "lengths": "SELECT city, last_hour - first_hour AS n FROM span",
    "stand_in": """
  SELECT city, hour + 1 AS idx, step, channel, x, y, cnt::DOUBLE AS yhat
  FROM demand JOIN lengths USING (city), (SELECT unnest(range(0, 5))::INTEGER AS step)
  WHERE hour + 1 BETWEEN 1 AND n - 5""",
    "truth": """
  SELECT city, hour - step AS idx, step, channel, x, y, cnt AS actual
  FROM demand JOIN lengths USING (city), (SELECT unnest(range(0, 5))::INTEGER AS step)
  WHERE hour - step BETWEEN 1 AND n - 5""",
    "aligned": """
  SELECT city, idx, step, channel, x, y, coalesce(yhat, 0e0) AS yhat, coalesce(actual, 0) AS actual
  FROM stand_in FULL JOIN truth USING (city, idx, step, channel, x, y)""",
    "by_step": """
  SELECT city, step, channel, sum((yhat - actual) ** 2) / any_value(nx * ny) AS total_mse,
    sum((yhat - actual) ** 2) / any_value(nx * ny) / any_value(n - 5) AS mean_mse
  FROM aligned JOIN dims USING (city) JOIN lengths USING (city) GROUP BY city, step, channel""",
    "totals": """
  SELECT city, idx, channel, sum(round_even(yhat, 0))::BIGINT AS pred, sum(actual)::BIGINT AS actual
  FROM aligned WHERE step = 0 GROUP BY city, idx, channel""",
    "overall": """
  SELECT city, sum((yhat - actual) ** 2) / any_value(nx * ny * 2 * 5 * (n - 5)) AS mse
  FROM aligned JOIN dims USING (city) JOIN lengths USING (city) GROUP BY city""",
    "report": """
  SELECT city, 'mse' AS metric, NULL::INTEGER AS channel, NULL::INTEGER AS step, NULL::BIGINT AS idx, mse::DOUBLE AS value FROM overall
  UNION ALL SELECT city, 'total_loss', channel, step, NULL, total_mse FROM by_step
  UNION ALL SELECT city, 'mean_loss', channel, step, NULL, mean_mse FROM by_step
  UNION ALL SELECT city, 'pred_demand', channel, NULL, idx, pred FROM totals
  UNION ALL SELECT city, 'actual_demand', channel, NULL, idx, actual FROM totals""",
    "hist": """
  SELECT city, cnt, count(*) AS cells, sum(count(*)) OVER (PARTITION BY city) AS n,
    coalesce(sum(count(*)) OVER (PARTITION BY city ORDER BY cnt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cells_below
  FROM demand GROUP BY city, cnt""",
    "visit_hist": """
  SELECT city, visits AS cnt, count(*) AS cells, sum(count(*)) OVER (PARTITION BY city) AS n,
    coalesce(sum(count(*)) OVER (PARTITION BY city ORDER BY visits ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cells_below
  FROM visits GROUP BY city, visits""",
    "visit_outliers": "SELECT city, cnt FROM visit_hist WHERE cells_below >= round_even(0.99e0 * n, 0)",
    "station_trips": """
  SELECT event_id AS trip_id, event_id % 2 AS file_ord,
    CASE event_id % 3 WHEN 0 THEN strftime(ts0, '%-m/%-d/%Y %-H:%M')
      WHEN 1 THEN strftime(ts0, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts0, '%-m/%-d/%Y') END AS start_time,
    CASE event_id % 3 WHEN 0 THEN date_trunc('minute', ts0)
      WHEN 1 THEN ts0 ELSE date_trunc('day', ts0) END AS start_ts,
    CASE event_id % 3 WHEN 0 THEN date_trunc('minute', ts1)
      WHEN 1 THEN ts1 ELSE date_trunc('day', ts1) END AS end_ts,
    (3000 + user_id % 40)::INTEGER AS start_station, (3000 + (event_id * 7919) % 43)::INTEGER AS end_station,
    CASE WHEN event_id % 5 <> 0 THEN 34e0 + (user_id % 40) / 100e0 END AS start_lat,
    -118e0 - (user_id % 40) / 100e0 AS start_lon,
    34e0 + ((event_id * 7919) % 43) / 100e0 AS end_lat,
    CASE WHEN event_id % 7 <> 0 THEN -118e0 - ((event_id * 7919) % 43) / 100e0 END AS end_lon
  FROM (SELECT *, date_trunc('second', ts) AS ts0,
          date_trunc('second', ts) + to_minutes(event_id % 50) AS ts1 FROM events)""",
    "station_rows": """
  SELECT (3000 + (s_suppkey * 7) % 47)::INTEGER AS id, 0 AS src, s_suppkey % 2 AS file_ord, 0 AS is_end, s_suppkey AS row_ord,
    CASE WHEN s_suppkey % 4 <> 0 THEN 33.5e0 + (s_suppkey % 10) / 100e0 END AS lat, NULL::DOUBLE AS lon,
    CASE WHEN s_suppkey % 3 <> 0 THEN make_timestamp(2016, 7, s_suppkey % 28 + 1, 0, 0, 0) END AS datetime
  FROM supplier""",
    "trip_rows": """
  SELECT start_station AS id, 1 AS src, file_ord, 0 AS is_end, trip_id AS row_ord, start_lat AS lat, start_lon AS lon, start_ts AS datetime FROM station_trips
  UNION ALL
  SELECT end_station, 1, file_ord, 1, trip_id, end_lat, end_lon, end_ts FROM station_trips""",
    "all_rows": "SELECT * FROM station_rows UNION ALL SELECT * FROM trip_rows",
    "stations": """
  SELECT *, row_number() OVER (ORDER BY id) - 1 AS tidx FROM (
    SELECT id,
      first(lat ORDER BY src, file_ord, is_end, row_ord) FILTER (WHERE lat IS NOT NULL) AS lat,
      first(lon ORDER BY src, file_ord, is_end, row_ord) FILTER (WHERE lon IS NOT NULL) AS lon,
      first(datetime ORDER BY src, file_ord, is_end, row_ord) FILTER (WHERE datetime IS NOT NULL) AS datetime
    FROM all_rows GROUP BY id)""",
    "od_tagged": """
  SELECT *, (epoch(start_ts)::BIGINT - epoch(TIMESTAMP '2016-07-07 04:00:00')::BIGINT) // 3600 AS hour FROM station_trips""",
    "od": """
  SELECT hour, o.tidx AS o_idx, d.tidx AS d_idx, count(*) AS trips
  FROM od_tagged t JOIN stations o ON o.id = t.start_station JOIN stations d ON d.id = t.end_station
  GROUP BY ALL""",
    "grid_hours": """
  SELECT city, hour, sum(cnt)::BIGINT AS total, sum(cnt * (x * 1009 + y * 9176 + channel * 31 + 1))::BIGINT AS weighted
  FROM filled WHERE channel IS NOT NULL GROUP BY city, hour""",
    "hour_values": """
  SELECT h.city, h.hour, h.n, h.first_hour, coalesce(total, 0) AS total, coalesce(weighted, 0) AS weighted
  FROM hours h LEFT JOIN grid_hours g ON g.city = h.city AND g.hour = h.hour""",
}

_FMT = "'%Y-%m-%d %H:%M:%S'"


def _station_select(source: str) -> str:
    order = "ORDER BY src, file_ord, is_end, row_ord"
    return f"""SELECT id,
      round(first(lat {order}) FILTER (WHERE lat IS NOT NULL), 6) AS lat,
      round(first(lon {order}) FILTER (WHERE lon IS NOT NULL), 6) AS lon,
      strftime(first(datetime {order}) FILTER (WHERE datetime IS NOT NULL), {_FMT}) AS datetime
    FROM {source} GROUP BY id"""


def _windows(gap: int) -> str:
    return f"""SELECT s.city, s.hour AS idx,
      sum(CASE WHEN v.hour < s.hour + 24 THEN v.total ELSE 0 END)::BIGINT AS features_total,
      sum(CASE WHEN v.hour < s.hour + 24 THEN v.weighted * (v.hour - s.hour + 1) ELSE 0 END)::BIGINT AS features_placed,
      sum(CASE WHEN v.hour >= s.hour + 24 + {gap} THEN v.total ELSE 0 END)::BIGINT AS labels_total,
      sum(CASE WHEN v.hour >= s.hour + 24 + {gap} THEN v.weighted * (v.hour - s.hour - 23 - {gap}) ELSE 0 END)::BIGINT AS labels_placed
    FROM hour_values s JOIN hour_values v ON v.city = s.city AND v.hour >= s.hour AND v.hour < s.hour + 29 + {gap}
    WHERE s.hour < s.n - 29 GROUP BY s.city, s.hour"""


_CTES["cells"] = "SELECT DISTINCT city, x, y, channel FROM demand"
_CTES["dense"] = """
  SELECT c.city, c.x, c.y, c.channel, h.hour, h.n, h.first_hour, floor(0.9e0 * h.n)::BIGINT AS cut, coalesce(d.cnt, 0) AS cnt
  FROM cells c JOIN hours h ON h.city = c.city
  LEFT JOIN demand d ON d.city = c.city AND d.hour = h.hour AND d.x = c.x AND d.y = c.y AND d.channel = c.channel"""
_CTES["lag_pairs"] = """
  SELECT y, x FROM (SELECT hour, cnt AS y, lag(cnt) OVER (PARTITION BY city, x, y, channel ORDER BY hour) AS x FROM dense WHERE hour < cut)
  WHERE x IS NOT NULL"""
_CTES["test_values"] = "SELECT city, x, y, channel, hour - cut AS t, n - cut AS m, first_hour + cut AS base, cnt FROM dense WHERE hour >= cut"
# A random draw of hours, and each part's hours numbered without holes.
_CTES["drawn"] = """
  SELECT city, hour, CASE WHEN ('0x' || substr(md5(concat_ws('|', city, hour::VARCHAR, '0')), 1, 8))::BIGINT % 1000000 < 800000
    THEN 'train' ELSE 'test' END AS part FROM hours"""
_CTES["placed"] = "SELECT *, row_number() OVER (PARTITION BY city, part ORDER BY hour) - 1 AS t, count(*) OVER (PARTITION BY city, part) AS m FROM drawn"
for _part in ("train", "test"):
    _CTES[f"drawn_{_part}"] = f"SELECT d.city, d.x, d.y, d.channel, p.t AS hour, cnt FROM demand d JOIN placed p ON p.city = d.city AND p.hour = d.hour AND part = '{_part}'"
    _CTES[f"drawn_{_part}_n"] = f"SELECT DISTINCT city, m AS n FROM placed WHERE part = '{_part}'"
_CTES["other_cells"] = "SELECT DISTINCT city, x, y, channel FROM drawn_test"
_CTES["other_values"] = """
  SELECT c.city, c.x, c.y, c.channel, p.t, p.m, 0 AS base, coalesce(d.cnt, 0) AS cnt
  FROM other_cells c JOIN placed p ON p.city = c.city AND part = 'test'
  LEFT JOIN drawn_test d ON d.city = c.city AND d.hour = p.t AND d.x = c.x AND d.y = c.y AND d.channel = c.channel"""


def _rolled(values: str, gap: int, result: str) -> str:
    """Fixed weights rolled out five steps over the windows of ``values``, each step fed with the one before."""
    at = f"TIMESTAMP '1970-01-01' + to_hours((i.base + i.t + 24 + {gap} + STEP)::BIGINT)"
    calendar = (
        f"CASE WHEN isodow({at}) > 1 THEN 0.011e0 * isodow({at}) ELSE 0e0 END"
        f" + CASE WHEN month({at}) > 1 THEN 0.003e0 * month({at}) ELSE 0e0 END + 0.07e0 * hour({at}) / 23e0 + 0.013e0"
    )
    place = "city, x, y, channel, t"
    steps = []
    for k in range(5):
        before = f"(SELECT *, cnt::DOUBLE AS yhat FROM {values})" if k == 0 else f"step{k - 1}"
        # The hour before the first step is the last of the window; later ones are forecasts.
        last = "l.t = i.t + 23" if k == 0 else "l.t = i.t"
        steps.append(
            f"""step{k} AS MATERIALIZED (SELECT i.city, i.x, i.y, i.channel, i.t, i.m, i.base,
              0.37e0 * l.yhat + 0.21e0 * d.cnt + {calendar.replace('STEP', str(k))} AS yhat, a.cnt AS actual
            FROM {values} i
            JOIN {before} l ON l.city = i.city AND l.x = i.x AND l.y = i.y AND l.channel = i.channel AND {last}
            JOIN {values} d ON d.city = i.city AND d.x = i.x AND d.y = i.y AND d.channel = i.channel AND d.t = i.t + {k}
            JOIN {values} a ON a.city = i.city AND a.x = i.x AND a.y = i.y AND a.channel = i.channel AND a.t = i.t + {24 + gap + k}
            WHERE i.t < i.m - 29)"""
        )
    every = " UNION ALL ".join(f"SELECT *, {k}::INTEGER AS step FROM step{k}" for k in range(5))
    head = "WITH " + ", ".join(steps) + f", rolled AS ({every}) "
    if result == "scores":
        return head + """SELECT city, t AS idx, step, channel, round(sum((yhat - actual) ** 2), 6) AS se,
          sum(round_even(yhat, 0))::BIGINT AS pred, sum(actual)::BIGINT AS actual FROM rolled GROUP BY city, t, step, channel"""
    return head + """SELECT city, round(sum((yhat - actual) ** 2) / any_value(nx * ny * 2 * 5 * (m - 29)), 6) AS mse
      FROM rolled JOIN dims USING (city) GROUP BY city"""


def _axes(train: str, lengths: str) -> str:
    """Per cell: mean counts m0, m1 of both channels, the axis v0, v1 of largest variance, and what lies off it."""
    return f"""SELECT *, m0 - v0 * (v0 * m0 + v1 * m1) AS b0, m1 - v1 * (v0 * m0 + v1 * m1) AS b1
      FROM (SELECT *, CASE WHEN q1 = 0 THEN 1e0 WHEN q0 = 0 THEN 0e0 WHEN b = 0 THEN (a > d)::INTEGER::DOUBLE ELSE b / sqrt(b * b + (top - a) ** 2) END AS v0,
          CASE WHEN q1 = 0 THEN 0e0 WHEN q0 = 0 THEN 1e0 WHEN b = 0 THEN (a <= d)::INTEGER::DOUBLE ELSE (top - a) / sqrt(b * b + (top - a) ** 2) END AS v1
        FROM (SELECT *, (a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b) AS top
          FROM (SELECT city, x, y, n, q0, q1, s0 / n AS m0, s1 / n AS m1, q0 / n - (s0 / n) ** 2 AS a, q1 / n - (s1 / n) ** 2 AS d, q01 / n - s0 / n * s1 / n AS b
            FROM (SELECT city, x, y, sum(c0)::DOUBLE AS s0, sum(c1)::DOUBLE AS s1, sum(c0 * c0)::DOUBLE AS q0, sum(c1 * c1)::DOUBLE AS q1, sum(c0 * c1)::DOUBLE AS q01
              FROM ({_pairs(train)}) GROUP BY city, x, y) JOIN {lengths} USING (city))))"""


def _pairs(source: str) -> str:
    return f"""SELECT city, x, y, hour, sum(CASE channel WHEN 0 THEN cnt ELSE 0 END) AS c0, sum(CASE channel WHEN 1 THEN cnt ELSE 0 END) AS c1
      FROM {source} GROUP BY city, x, y, hour"""


def _coded(train: str, test: str, lengths: str) -> str:
    """Each hour of a known cell with its code ``z``, from the channels the axis knows."""
    return f"""SELECT a.*, hour, v0 * c0 + v1 * c1 AS z FROM ({_axes(train, lengths)}) a JOIN ({_pairs(test)}) p USING (city, x, y)
      WHERE q0 > 0 AND c0 > 0 OR q1 > 0 AND c1 > 0"""


def _lost(train: str, test: str, train_n: str, test_n: str) -> str:
    """Mean squared error over known and unseen columns: hour by hour where there were trips, else ``base`` alone."""
    return f"""WITH axes AS MATERIALIZED ({_axes(train, train_n)}), pairs AS ({_pairs(test)}),
      busy AS (SELECT city, sum(CASE WHEN q0 > 0 THEN (c0 - b0 - v0 * z) ** 2 ELSE coalesce(c0, 0) ** 2 END
          + CASE WHEN q1 > 0 THEN (c1 - b1 - v1 * z) ** 2 ELSE c1 ** 2 END
          - CASE WHEN q0 > 0 THEN b0 * b0 ELSE 0e0 END - CASE WHEN q1 > 0 THEN b1 * b1 ELSE 0e0 END) AS se
        FROM (SELECT p.*, q0, q1, b0, b1, v0, v1, CASE WHEN q0 > 0 THEN v0 * c0 ELSE 0e0 END + CASE WHEN q1 > 0 THEN v1 * c1 ELSE 0e0 END AS z
          FROM pairs p LEFT JOIN axes USING (city, x, y)) GROUP BY city),
      quiet AS (SELECT city, sum((q0 > 0)::INTEGER * b0 * b0 + (q1 > 0)::INTEGER * b1 * b1) AS off, sum((q0 > 0)::INTEGER + (q1 > 0)::INTEGER) AS known FROM axes GROUP BY city),
      unseen AS (SELECT city, count(*) AS fresh FROM (SELECT DISTINCT t.city, t.x, t.y, t.channel FROM {test} t
        LEFT JOIN axes a ON a.city = t.city AND a.x = t.x AND a.y = t.y WHERE coalesce(CASE t.channel WHEN 0 THEN q0 ELSE q1 END, 0) = 0) GROUP BY city)
      SELECT city, round((se + off * n) / ((known + coalesce(fresh, 0)) * n), 6) AS mse
      FROM busy JOIN quiet USING (city) JOIN {test_n} USING (city) LEFT JOIN unseen USING (city)"""


# Counts by tiles of four cells a side; per pair of cells of a tile the sum of their products
# over the hours, and from it their covariance times the squared hours.
_TILED = """tiled AS (SELECT *, floor(x / 4e0)::INTEGER AS tx, floor(y / 4e0)::INTEGER AS ty FROM demand),
      known AS (SELECT city, tx, ty, x, y, channel, sum(cnt) AS total FROM tiled GROUP BY ALL),
      pairs AS (SELECT city, hour, tx, ty, a.x AS xa, a.y AS ya, a.channel AS ca, b.x AS xb, b.y AS yb, b.channel AS cb, a.cnt * b.cnt AS ab
        FROM tiled a JOIN tiled b USING (city, hour, tx, ty)),
      products AS (SELECT city, xa, ya, ca, xb, yb, cb, sum(ab) AS product FROM pairs GROUP BY ALL),
      covariance AS (SELECT p.city, xa, ya, ca, xb, yb, cb, product * n - a.total * b.total AS shared
        FROM products p JOIN lengths l ON l.city = p.city
          JOIN known a ON a.city = p.city AND a.x = xa AND a.y = ya AND a.channel = ca
          JOIN known b ON b.city = p.city AND b.x = xb AND b.y = yb AND b.channel = cb)"""


_FINAL = {
    "scan_trips": """SELECT trip_id, city, start_time_utc, end_time_utc, round(start_lat, 6) AS start_lat,
      round(start_lon, 6) AS start_lon, round(end_lat, 6) AS end_lat, round(end_lon, 6) AS end_lon,
      round(distance_miles, 6) AS distance_miles FROM trips_fx""",
    "scan_trips_quoted": """SELECT trip_id, start_time_utc, 'by ' || scooter_id || ', "no"' || repeat(chr(10) || ', x', (trip_id % 4)::INTEGER) AS note
      FROM trips_fx WHERE city = 'a'""",
    "encode_grid": f"""WITH {_TILED}
      SELECT city, hour, tx, ty, energy::DOUBLE AS energy, round(sqrt(greatest(along, 0) / (n * n * energy)::DOUBLE), 6) AS spread
      FROM (SELECT city, hour, tx, ty, sum(CASE WHEN xa = xb AND ya = yb AND ca = cb THEN ab END) AS energy, sum(ab * shared)::DOUBLE AS along
        FROM pairs JOIN covariance USING (city, xa, ya, ca, xb, yb, cb) GROUP BY ALL) JOIN lengths USING (city)""",
    "cell_ids_kept": """WITH seen AS (SELECT city, x, y, min(trip_id * 2 + channel) AS seen, min(CASE WHEN trip_id % 2 = 0 THEN trip_id * 2 + channel END) AS first FROM ends GROUP BY ALL)
      SELECT city, x, y, row_number() OVER (PARTITION BY city ORDER BY first IS NULL, coalesce(first, seen)) - 1 AS cell_id, (first IS NULL)::INTEGER AS version FROM seen""",
    "publish_tables": """SELECT city, hour, channel, x, y, cnt, sum(cnt) OVER (PARTITION BY city)::BIGINT AS total
      FROM (SELECT * REPLACE (CASE WHEN city = 'b' THEN 2 * cnt ELSE cnt END AS cnt) FROM demand)""",
    "decode_grid": f"""WITH {_TILED}
      SELECT k.city, h.hour, k.channel, k.x, k.y, coalesce(d.cnt, 0)::DOUBLE AS yhat, sum(b.cnt * (coalesce(c.product, 0) * n - k.total * s.total))::DOUBLE AS shared
      FROM known k JOIN (SELECT DISTINCT city, hour, tx, ty FROM tiled) h USING (city, tx, ty) JOIN lengths l ON l.city = k.city
        LEFT JOIN demand d ON d.city = k.city AND d.hour = h.hour AND d.x = k.x AND d.y = k.y AND d.channel = k.channel
        JOIN tiled b ON b.city = k.city AND b.hour = h.hour AND b.tx = k.tx AND b.ty = k.ty
        JOIN known s ON s.city = b.city AND s.x = b.x AND s.y = b.y AND s.channel = b.channel
        LEFT JOIN products c ON c.city = k.city AND xa = k.x AND ya = k.y AND ca = k.channel AND xb = b.x AND yb = b.y AND cb = b.channel
      GROUP BY ALL""",
    "conv_surroundings": """SELECT city, hour, tx::INTEGER AS tx, ty::INTEGER AS ty, count(*) AS cells, sum(cnt)::BIGINT AS cnt, sum(((x - tx * 8 + 3) * 14 + y - ty * 8 + 3) * 2 + channel)::BIGINT AS slots
      FROM (SELECT *, unnest(range(floor((x - 3) / 8e0)::BIGINT, floor((x + 2) / 8e0)::BIGINT + 2)) AS tx FROM demand) a
        CROSS JOIN LATERAL (SELECT unnest(range(floor((y - 3) / 8e0)::BIGINT, floor((y + 2) / 8e0)::BIGINT + 2)) AS ty)
      WHERE x - tx * 8 BETWEEN -3 AND 10 AND y - ty * 8 BETWEEN -3 AND 10
      GROUP BY city, hour, tx, ty""",
    "scan_trips_drift": """SELECT trip_id, file_ord, start_time, start_station, end_station,
      CASE WHEN file_ord = 0 THEN round(start_lat, 6) END AS start_lat FROM station_trips""",
    "scan_stations": f"SELECT id, lat, datetime FROM ({_station_select('station_rows')})",
    "scan_demand": f"""SELECT city, f.hour, strftime(to_timestamp((first_hour + f.hour) * 3600) AT TIME ZONE 'UTC', {_FMT}) AS t0,
      strftime(to_timestamp((first_hour + f.hour + 1) * 3600) AT TIME ZONE 'UTC', {_FMT}) AS t1, channel, x, y, cnt
      FROM filled f JOIN span USING (city) WHERE city = 'a'""",
    "city_jobs": """SELECT city, count(DISTINCT hour) AS hours, count(channel) AS cells, sum(cnt)::BIGINT AS ends
      FROM filled GROUP BY city""",
    "write_cells": """SELECT city, x, y, row_number() OVER (PARTITION BY city ORDER BY seen) - 1 AS cell_id, visits
      FROM (SELECT city, x, y, min(trip_id * 2 + channel) AS seen, count(*) AS visits FROM ends GROUP BY ALL)""",
    "write_trips": "SELECT trip_id, city, start_hour, end_hour, start_x, start_y, end_x, end_y FROM gridded",
    "write_demand": "SELECT city, hour, channel, x, y, cnt + CASE city WHEN 'a' THEN 100 ELSE 0 END AS cnt FROM filled",
    "write_od": "SELECT hour, o_idx, d_idx, trips FROM od",
    "write_stations": f"""SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon, strftime(datetime, {_FMT}) AS datetime, tidx FROM stations""",
    "append_eval": """SELECT city, run_id, metric, channel, step, idx, round(value, 6) AS value
      FROM report, (VALUES ('one'), ('two')) AS runs(run_id)""",
    "split_date": "SELECT event_id AS trip_id, strftime(ts, '%m/%d/%Y') AS start_day FROM events",
    "join_date_time": "SELECT event_id AS trip_id, strftime(ts, '%m/%d/%YT%H:%M:%S') AS start_text FROM events",
    "parse_ts": f"SELECT trip_id, strftime(start_time_utc, {_FMT}) AS start_ts FROM typed",
    "parse_ts_multi": f"SELECT trip_id, strftime(start_ts, {_FMT}) AS start_ts FROM station_trips",
    "is_valid_ts": """SELECT trip_id,
      (try_strptime(start_time_utc, '%Y-%m-%dT%H:%M:%SZ') IS NOT NULL)::INTEGER AS valid_a,
      (try_strptime(start_time_utc, '%m/%d/%YT%H:%M:%S') IS NOT NULL)::INTEGER AS valid_b,
      (try_strptime(start_time_utc, '%Y-%m-%dT%H:%M') IS NOT NULL)::INTEGER AS valid_c FROM trips_fx""",
    "hour_tag": "SELECT trip_id, epoch(start_time_utc)::BIGINT // 3600 AS hour FROM typed",
    "hour_tag_origin": "SELECT trip_id, hour FROM od_tagged",
    "tag_to_ts": f"""SELECT trip_id, strftime(date_trunc('hour', start_time_utc), {_FMT}) AS hour_start,
      strftime(date_trunc('hour', start_time_utc), {_FMT}) AS origin_hour_start FROM typed""",
    "hour_interval": f"""SELECT city, hour, strftime(TIMESTAMP '1970-01-01' + to_hours(first_hour + hour), {_FMT}) AS t0,
      strftime(TIMESTAMP '1970-01-01' + to_hours(first_hour + hour + 1), {_FMT}) AS t1 FROM hours""",
    "cast_coords": """SELECT event_id AS trip_id, v AS start_lat, v AS start_lon, v AS end_lat, v AS end_lon
      FROM (SELECT event_id, CASE WHEN event_id % 211 = 5 OR event_id % 223 = 7 THEN NULL
        ELSE (event_id % 400) + 0.25e0 END AS v FROM events)""",
    "grid_cell": "SELECT trip_id, start_x AS x, start_y AS y FROM gridded",
    "grid_trips": "SELECT trip_id, start_x, start_y, end_x, end_y FROM gridded",
    "zscore": "SELECT trip_id, round((end_lon - mean) / std, 6) AS z FROM whole JOIN lon_stats USING (city)",
    "minmax": "SELECT event_id, round(value / 250e0, 6) AS scaled FROM events",
    "inv_minmax": "SELECT event_id, round_even((event_id % 101) / 100e0 * 50, 0) AS cnt FROM events",
    "round_pred": "SELECT event_id, round_even((event_id % 41 - 20) / 2e0, 0)::BIGINT AS pred FROM events",
    "one_hot": """SELECT event_id, repeat('0', (event_id % 5)::INTEGER) || '1' || repeat('0', (4 - event_id % 5)::INTEGER) AS slots FROM events""",
    "time_features": """SELECT trip_id, 20 AS width, isodow(start_time_utc) - 1 AS weekday, month(start_time_utc) AS month,
      round(hour(start_time_utc) / 23e0, 6) AS hour_share, round(2 + hour(start_time_utc) / 23e0, 6) AS total FROM typed""",
    "project_needed": f"""SELECT city, strftime(start_time_utc, {_FMT}) AS start_time_utc, strftime(end_time_utc, {_FMT}) AS end_time_utc,
      round(start_lat, 6) AS start_lat, round(start_lon, 6) AS start_lon, round(end_lat, 6) AS end_lat, round(end_lon, 6) AS end_lon FROM typed""",
    "rename_cols": """SELECT trip_id, start_station AS id, round(start_lat, 6) AS lat, round(start_lon, 6) AS lon, start_time AS time FROM station_trips""",
    "dense_grid": """SELECT h.city, h.hour, (2 * any_value(nx) * any_value(ny))::INTEGER AS cells, coalesce(sum(cnt), 0)::BIGINT AS total,
      coalesce(sum(cnt * ((channel * nx + x_idx) * ny + y_idx)), 0)::BIGINT AS placed_total
      FROM hours h JOIN dims USING (city) LEFT JOIN demand d ON d.city = h.city AND d.hour = h.hour
      LEFT JOIN x_axis a ON a.city = d.city AND a.x = d.x LEFT JOIN y_axis b ON b.city = d.city AND b.y = d.y
      GROUP BY h.city, h.hour""",
    "drop_zero_distance": "SELECT trip_id, round(distance_miles, 6) AS distance_miles FROM trips_fx WHERE distance_miles <> 0",
    "drop_nulls": "SELECT trip_id, round(end_lat, 6) AS end_lat FROM trips_fx WHERE end_lat IS NOT NULL AND distance_miles IS NOT NULL",
    "zscore_filter": "SELECT trip_id, city FROM clean",
    "valid_ts_filter": "SELECT trip_id FROM trips_fx WHERE city = 'b'",
    "high_demand_cells": """SELECT v.city, x, y, visits, 'z' AS rule FROM visits v
      JOIN (SELECT city, avg(visits) AS m, stddev_pop(visits) AS s FROM visits GROUP BY city) z ON z.city = v.city
      WHERE (visits - m) / s > -3
      UNION ALL SELECT city, x, y, visits, 'count' FROM visits WHERE visits >= 12""",
    "trips_in_cells": """SELECT trip_id, g.city FROM gridded g
      JOIN visits a ON a.city = g.city AND a.x = start_x AND a.y = start_y AND a.visits >= 12
      JOIN visits b ON b.city = g.city AND b.x = end_x AND b.y = end_y AND b.visits >= 12""",
    "clip_outlier_cells": """SELECT v.city, x, y, CASE WHEN o.cnt IS NULL THEN visits ELSE 0 END AS cnt
      FROM visits v LEFT JOIN visit_outliers o ON o.city = v.city AND o.cnt = visits""",
    "bounding_box": """SELECT city, round(min_lat, 6) AS min_lat, round(min_lon, 6) AS min_lon,
      round(max_lat, 6) AS max_lat, round(max_lon, 6) AS max_lon FROM box""",
    "pooled_stats": """SELECT city, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std
      FROM (SELECT city, start_lat AS v FROM whole UNION ALL SELECT city, end_lat FROM whole) GROUP BY city""",
    "cell_visits": "SELECT * FROM visits",
    "hourly_demand": "SELECT * FROM demand",
    "hourly_demand_by_end": """SELECT city, CASE channel WHEN 0 THEN start_hour ELSE end_hour END AS hour, channel, x, y, count(*) AS cnt
      FROM ends GROUP BY ALL""",
    "total_demand": "SELECT city, hour, sum(cnt)::BIGINT AS total FROM filled GROUP BY city, hour",
    "station_first": _station_select("station_rows"),
    "stations_from_trips": _station_select("trip_rows"),
    "station_table": f"""SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon, strftime(datetime, {_FMT}) AS datetime, tidx FROM stations""",
    "od_matrix": f"""SELECT hour, strftime(TIMESTAMP '2016-07-07 04:00:00' + to_hours(hour), {_FMT}) AS dat, o_idx, d_idx, trips FROM od""",
    "od_hour_count": f"""SELECT hour, strftime(TIMESTAMP '2016-07-07 04:00:00' + to_hours(hour), {_FMT}) AS dat, count(*) AS cnt
      FROM od_tagged GROUP BY hour""",
    "od_max": "SELECT max(trips) AS max_trips FROM od",
    "demand_max": "SELECT city, max(cnt) AS max_cnt FROM demand GROUP BY city",
    "normalize_demand": """SELECT d.*, round(cnt / (max(cnt) OVER (PARTITION BY city))::DOUBLE, 6) AS scaled FROM demand d""",
    "outlier_values": """SELECT city, cnt, 'hourly' AS source FROM hist WHERE cells_below >= round_even(0.9999e0 * n, 0)
      UNION ALL SELECT city, cnt, 'visits' FROM visit_outliers""",
    "mse": "SELECT city, round(mse, 6) AS mse FROM overall",
    "horizon_mse": "SELECT city, step, channel, round(total_mse, 6) AS total_mse, round(mean_mse, 6) AS mean_mse FROM by_step",
    "demand_pred_vs_actual": "SELECT * FROM totals",
    "stats_join": """SELECT trip_id, round(mean, 6) AS mean, round(std, 6) AS std FROM whole,
      (SELECT avg(v) AS mean, stddev_pop(v) AS std FROM (SELECT start_lon AS v FROM whole UNION ALL SELECT end_lon FROM whole))""",
    "axis_lookup": "SELECT city, hour, channel, x, y, x_idx, y_idx, cnt FROM demand JOIN x_axis USING (city, x) JOIN y_axis USING (city, y)",
    "station_lookup": """SELECT hour, CASE WHEN known THEN o ELSE -1 END AS o_idx, CASE WHEN known THEN d ELSE -1 END AS d_idx, count(*) AS trips
      FROM (SELECT hour, o.tidx AS o, d.tidx AS d, o.tidx IS NOT NULL AND d.tidx IS NOT NULL AS known
        FROM od_tagged t LEFT JOIN named o ON o.id = t.start_station LEFT JOIN named d ON d.id = t.end_station)
      GROUP BY ALL""",
    "pred_actual_join": "SELECT * FROM aligned",
    "outlier_member": "SELECT v.city, x, y, visits AS cnt FROM visits v JOIN visit_outliers o ON o.city = v.city AND o.cnt = visits",
    "cell_member": "SELECT d.* FROM demand d JOIN visits v USING (city, x, y) WHERE visits >= 12",
    "cell_ids": """SELECT city, x, y, row_number() OVER (PARTITION BY city ORDER BY seen) - 1 AS cell_id, visits
      FROM (SELECT city, x, y, min(trip_id * 2 + channel) AS seen, count(*) AS visits FROM ends GROUP BY ALL)""",
    "axis_rank": "SELECT city, 'x' AS axis, x AS place, x_idx AS idx FROM x_axis UNION ALL SELECT city, 'y', y, y_idx FROM y_axis",
    "station_index": "SELECT id, row_number() OVER (ORDER BY id) - 1 AS tidx FROM (SELECT DISTINCT id FROM trip_rows)",
    "rebase_hours": "SELECT trip_id, start_hour, end_hour FROM gridded",
    "fill_hours": "SELECT * FROM filled",
    "fill_od_hours": f"""SELECT h.hour, strftime(TIMESTAMP '2016-07-07 04:00:00' + to_hours(h.hour), {_FMT}) AS dat, coalesce(c.cnt, 0) AS cnt
      FROM (SELECT unnest(range(0, (SELECT max(hour) + 1 FROM od_tagged))) AS hour) h
      LEFT JOIN (SELECT hour, count(*) AS cnt FROM od_tagged GROUP BY hour) c ON c.hour = h.hour""",
    "sliding_windows": _windows(0),
    "sliding_windows_gap": _windows(1),
    "sample_time_features": """SELECT city, idx, pos, isodow(t) - 1 AS weekday, round(hour(t) / 23e0, 6) AS hour_share
      FROM (SELECT city, hour AS idx, pos, TIMESTAMP '1970-01-01' + to_hours(first_hour + hour + pos) AS t
        FROM hours, (SELECT unnest(range(0, 29))::INTEGER AS pos) WHERE hour < n - 29)""",
    "sort_by_hour": "SELECT city, hour, channel, x, y, cnt FROM demand",
    "nth_sample": """SELECT a.* FROM aligned a JOIN (SELECT city, least(20, max(idx)) AS k FROM aligned GROUP BY city) m
      ON m.city = a.city AND a.idx = k""",
    "pos_modulo": "SELECT city, hour, channel, x, y, ((hour * 7 - 3) % (n - 29) + (n - 29)) % (n - 29) AS pos FROM demand JOIN lengths USING (city)",
    "union_ends": "SELECT city, trip_id, channel, x, y FROM ends",
    "union_stations": f"""SELECT id, src, round(lat, 6) AS lat, round(lon, 6) AS lon, strftime(datetime, {_FMT}) AS datetime FROM all_rows""",
    "distinct_axis": "SELECT DISTINCT city, x FROM ends",
    "value_except": "SELECT city, cnt FROM visit_outliers",
    "split_chrono": """SELECT d.*, CASE WHEN hour < floor(0.9e0 * n) THEN 'train' ELSE 'test' END AS part
      FROM demand d JOIN lengths l ON l.city = d.city WHERE hour < n""",
    "lag_features": """SELECT city, hour, l1::BIGINT AS lag_1, l2::BIGINT AS lag_2, l3::BIGINT AS lag_3, l24::BIGINT AS lag_24, weighted AS label,
        isodow(t) - 1 AS weekday, round(hour(t) / 23e0, 6) AS hour_share
      FROM (SELECT *, TIMESTAMP '1970-01-01' + to_hours(first_hour + hour) AS t, lag(weighted, 1) OVER w AS l1, lag(weighted, 2) OVER w AS l2,
          lag(weighted, 3) OVER w AS l3, lag(weighted, 24) OVER w AS l24
        FROM hour_values WINDOW w AS (PARTITION BY city ORDER BY hour))
      WHERE hour >= 24""",
    "fit_forecaster_lag": """SELECT 'lag_1' AS input, round(regr_slope(y, x), 6) AS weight FROM lag_pairs
      UNION ALL SELECT 'intercept', round(regr_intercept(y, x), 6) FROM lag_pairs
      UNION ALL SELECT 'loss', round((regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)) / count(*), 6) FROM lag_pairs""",
    "loss_history_lag": """SELECT pass, round(loss, 6) AS loss
      FROM (SELECT (regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)) / count(*) AS loss FROM lag_pairs),
        (SELECT unnest(range(0, 2))::INTEGER AS pass)""",
    "save_load_model_fixed": _rolled("test_values", 0, "scores"),
    "forecast_recursive_fixed": _rolled("test_values", 0, "scores"),
    "exp_plain_fixed": _rolled("other_values", 1, "mse"),
    "encode_grid_cell": f"SELECT city, hour, x, y, round(z * z, 6) AS energy FROM ({_coded('demand', 'demand', 'lengths')})",
    "decode_grid_cell": f"""SELECT city, hour, channel, x, y, round(CASE channel WHEN 0 THEN b0 + v0 * z ELSE b1 + v1 * z END, 6) AS yhat
      FROM ({_coded('demand', 'demand', 'lengths')}), (SELECT unnest([0, 1])::INTEGER AS channel)
      WHERE CASE channel WHEN 0 THEN q0 ELSE q1 END > 0""",
    "reconstruction_mse_cell": _lost("demand", "demand", "lengths", "lengths"),
    "exp_autoencoder_cell": _lost("drawn_train", "drawn_test", "drawn_train_n", "drawn_test_n"),
    "split_random": "SELECT city, hour, part FROM drawn",
    "score_forecast": "SELECT city, metric, channel, step, idx, round(value, 6) AS value FROM report",
    "heatmap_cells": """SELECT a.city, x, y, channel, actual, round_even(yhat, 0)::BIGINT AS pred
      FROM aligned a JOIN (SELECT city, least(20, max(idx)) AS k FROM aligned WHERE step = 0 GROUP BY city) m
      ON m.city = a.city AND a.idx = k WHERE step = 0""",
    "series_total_demand": """SELECT city, metric, channel, idx, round(value, 6) AS value FROM report
      WHERE metric IN ('pred_demand', 'actual_demand')""",
    "series_loss": """SELECT city, metric, channel, step, round(value, 6) AS value FROM report
      WHERE metric IN ('total_loss', 'mean_loss')""",
}

_CTES["named"] = """
  SELECT id, row_number() OVER (ORDER BY id) - 1 AS tidx FROM (
    SELECT id, first(lat ORDER BY file_ord, row_ord) FILTER (WHERE lat IS NOT NULL) AS lat FROM station_rows GROUP BY id)
  WHERE lat >= 33.54e0"""


def _needed(sql: str) -> list[str]:
    """The table expressions a statement uses, directly or through others."""
    found: set[str] = set()
    queue = [sql]
    while queue:
        words = set(re.findall(r"[a-z_]+", queue.pop()))
        fresh = (words & set(_CTES)) - found
        found |= fresh
        queue += [_CTES[n] for n in fresh]
    return [n for n in _CTES if n in found]


def _statement(sql: str) -> str:
    # A column may share its name with an expression; an unused expression is harmless.
    parts = ",\n".join(f"{n} AS MATERIALIZED ({_CTES[n]})" for n in _needed(sql))
    if not parts:
        return sql
    return f"WITH {parts},\n{sql.removeprefix('WITH ')}" if sql.startswith("WITH ") else f"WITH {parts}\n{sql}"


ORACLES = {name: _statement(sql) for name, sql in _FINAL.items()}
