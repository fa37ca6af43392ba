"""The queries' equivalents in SQL, for DuckDB over the same tables."""

from __future__ import annotations

from waymark.functions.geo import FLATTENING, MAJOR, MINOR

POINTS = """tracks AS (
  SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
         47.0::DOUBLE + value / 10000.0::DOUBLE AS lat,
         -122.0::DOUBLE + (epoch_us(ts)::DOUBLE / 1e6::DOUBLE - 1704067200.0::DOUBLE) / 5184000.0::DOUBLE AS lng,
         CASE WHEN event_type = 'error' THEN NULL ELSE value END AS ele, event_type
  FROM events
), points AS (SELECT track_id, seq, lat, lng, ele FROM tracks)"""

#: Tracks with bearings.
TWO_OR_MORE = "points_b AS (SELECT p.* FROM points p JOIN (SELECT track_id FROM points GROUP BY track_id HAVING count(*) > 1) USING (track_id))"

LOOKUPS = """lookups AS (
  SELECT track_id, seq, CASE WHEN event_type = 'error' THEN 'ZERO_RESULTS' ELSE 'OK' END AS status,
         floor(lng * 500)::BIGINT::VARCHAR AS pano_id, round(lat, 3) AS pano_lat, round(lng, 3) AS pano_lng
  FROM tracks
), zipped AS (SELECT * FROM points JOIN lookups USING (track_id, seq))"""


def distance(name: str, source: str, lat1: str, lng1: str, lat2: str, lng2: str, out: str) -> str:
    """CTEs that end in `name`: source with the ellipsoidal distance, seven passes of the iteration written out."""
    f = repr(FLATTENING)
    d = lambda x: f"{x!r}::DOUBLE"
    steps = [
        f"SELECT *, atan((1 - {f}::DOUBLE) * tan(radians({lat1}))) AS u1, atan((1 - {f}::DOUBLE) * tan(radians({lat2}))) AS u2, radians({lng2} - {lng1}) AS l0 FROM {source}",
        "SELECT *, sin(u1) AS su1, cos(u1) AS cu1, sin(u2) AS su2, cos(u2) AS cu2, l0 AS lam FROM {0}",
    ]
    for _ in range(7):
        steps += [
            "SELECT * EXCLUDE (lam), sin(lam) AS sl, cos(lam) AS cl FROM {0}",
            "SELECT * EXCLUDE (sl, cl), sqrt((cu2 * sl) * (cu2 * sl) + (cu1 * su2 - su1 * cu2 * cl) * (cu1 * su2 - su1 * cu2 * cl)) AS ss, su1 * su2 + cu1 * cu2 * cl AS cs, sl FROM {0}",
            "SELECT * EXCLUDE (sl), atan2(ss, cs) AS sig, CASE WHEN ss = 0 THEN 0 ELSE cu1 * cu2 * sl / nullif(ss, 0) END AS sa FROM {0}",
            "SELECT *, 1 - sa * sa AS c2 FROM {0}",
            f"SELECT *, CASE WHEN c2 = 0 THEN 0 ELSE cs - 2 * su1 * su2 / nullif(c2, 0) END AS m, {f}::DOUBLE / 16 * c2 * (4 + {f}::DOUBLE * (4 - 3 * c2)) AS cc FROM {{0}}",
            f"SELECT *, l0 + (1 - cc) * {f}::DOUBLE * sa * (sig + cc * ss * (m + cc * cs * (2 * m * m - 1))) AS lam FROM {{0}}",
            "SELECT * EXCLUDE (ss, cs, sig, sa, c2, m, cc), ss AS ss_, cs AS cs_, sig AS sig_, c2 AS c2_, m AS m_ FROM {0}",
        ]
        if _ < 6:
            steps.append("SELECT * EXCLUDE (ss_, cs_, sig_, c2_, m_) FROM {0}")
    steps += [
        f"SELECT * EXCLUDE (u1, u2, l0, su1, cu1, su2, cu2, lam), c2_ * {d((MAJOR**2 - MINOR**2) / MINOR**2)} AS q FROM {{0}}",
        "SELECT *, 1 + q / 16384.0::DOUBLE * (4096 + q * (-768 + q * (320 - 175 * q))) AS a_, q / 1024.0::DOUBLE * (256 + q * (-128 + q * (74 - 47 * q))) AS b_ FROM {0}",
        f"SELECT * EXCLUDE (ss_, cs_, sig_, c2_, m_, q, a_, b_), {d(MINOR)} * a_ * (sig_ - b_ * ss_ * (m_ + b_ / 4 * (cs_ * (2 * m_ * m_ - 1) - b_ / 6 * m_ * (4 * ss_ * ss_ - 3) * (4 * m_ * m_ - 3)))) AS {out} FROM {{0}}",
    ]
    names = [f"{name}_{i}" for i in range(len(steps) - 1)] + [name]
    return ", ".join(f"{n} AS ({s.format(names[i - 1]) if i else s})" for i, (n, s) in enumerate(zip(names, steps, strict=True)))


def stepped(source: str = "points") -> str:
    """CTE steps: points with the distance from the one before."""
    lag = f"pairs AS (SELECT *, lag(lat) OVER w AS p_lat, lag(lng) OVER w AS p_lng FROM {source} WINDOW w AS (PARTITION BY track_id ORDER BY seq))"
    return lag + ", " + distance("steps", "pairs", "p_lat", "p_lng", "lat", "lng", "step")


def turn(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    angle = f"degrees(atan2(sin(radians({lng2} - {lng1})) * cos(radians({lat2})), cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos(radians({lng2} - {lng1})))) + 360"
    return f"CASE WHEN {angle} >= 360 THEN {angle} - 360 ELSE {angle} END"


def bearings(source: str, name: str = "bearings") -> str:
    return f"""{name}_n AS (SELECT *, lead(lat) OVER w AS n_lat, lead(lng) OVER w AS n_lng FROM {source} WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
{name}_b AS (SELECT *, {turn("lat", "lng", "n_lat", "n_lng")} AS b FROM {name}_n),
{name} AS (SELECT * EXCLUDE (b, n_lat, n_lng), coalesce(b, lag(b) OVER (PARTITION BY track_id ORDER BY seq)) AS bearing FROM {name}_b QUALIFY bearing IS NOT NULL)"""


W = "PARTITION BY track_id ORDER BY seq"
LENGTHS = "lengths AS (SELECT track_id, coalesce(sum(step), 0) AS length, count(*) AS points FROM steps GROUP BY track_id)"


def sampled(n: str, source: str = "steps", name: str = "sampled") -> str:
    """The greedy walk in closed form; here the due samples are counted with a join over all k instead of a quotient."""
    return f"""{name}_r AS (SELECT *, sum(coalesce(step, 0)) OVER (PARTITION BY track_id ORDER BY seq) AS run, sum(coalesce(step, 0)) OVER (PARTITION BY track_id) / ({n} - 0.99::DOUBLE) AS gap FROM {source}),
{name}_t AS (SELECT *, CASE WHEN gap = 0 THEN 1000000000 ELSE floor(run / nullif(gap, 0)) END AS m FROM {name}_r),
{name}_u AS (SELECT *, CASE WHEN gap = 0 THEN m WHEN gap * (m + 1) <= run THEN m + 2 WHEN gap * m > run THEN m ELSE m + 1 END - seq AS late FROM {name}_t),
{name}_k AS (SELECT *, least(seq + 1, seq + min(late) OVER ({W} ROWS UNBOUNDED PRECEDING)) AS taken FROM {name}_u),
{name}_l AS (SELECT *, coalesce(lag(taken) OVER ({W}), 0) AS before FROM {name}_k),
{name} AS (SELECT track_id, row_number() OVER ({W}) - 1 AS seq, lat, lng, ele FROM {name}_l WHERE taken > before AND taken <= {n})"""


def x0(lng: str) -> str:
    return f"(256 * ({lng} + 180) / 360)"


def y0(lat: str) -> str:
    return f"(128 - 0.5::DOUBLE * ln((1 + sin(radians({lat}))) / (1 - sin(radians({lat})))) * 128 / pi())"


def pixel(lat: str, lng: str, c_lat: str, c_lng: str, zoom: str, size: int) -> tuple[str, str]:
    return f"({size / 2} + ({x0(lng)} - {x0(c_lng)}) * pow(2, {zoom}))", f"({size / 2} + ({y0(lat)} - {y0(c_lat)}) * pow(2, {zoom}))"


def seen(x: str, y: str, size: int) -> str:
    return f"({x} BETWEEN 0 AND {size} AND {y} BETWEEN 0 AND {size})"


def fit(north: str, south: str, east: str, west: str, size: int) -> str:
    extent = f"greatest(abs({x0(east)} - {x0(west)}), abs({y0(south)} - {y0(north)}))"
    return f"CASE WHEN {extent} <= 0 THEN 21 ELSE greatest(0, least(21, floor(log2({size} / nullif({extent}, 0)))))::INTEGER END"


def clipped(zoom: int) -> str:
    x, y = pixel("lat", "lng", "47.005::DOUBLE", "-121.8::DOUBLE", str(zoom), 192)
    return f"""visible AS (SELECT *, {seen(x, y, 192)} AS visible FROM points),
kept AS (SELECT *, visible OR coalesce(lag(visible) OVER ({W}), false) OR coalesce(lead(visible) OVER ({W}), false) AS kept FROM visible),
islands AS (SELECT *, seq - row_number() OVER ({W}) AS island FROM kept WHERE kept),
runs AS (SELECT track_id, island, min(seq) AS start, count(*) AS n, arg_min(lng, seq) AS first_lng FROM islands GROUP BY track_id, island),
numbered AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY start) - 1 AS run FROM runs)"""


GAP_POINTS = """thin AS (
  SELECT track_id, seq, CASE WHEN seq % 37 = 0 THEN lat ELSE 47.0 END AS lat,
         -122.0::DOUBLE + seq / 1e5::DOUBLE + CASE WHEN seq % 37 < 2 THEN lng + 122.0::DOUBLE ELSE 0 END AS lng, ele
  FROM points)"""


def gap_ctes(source: str = "points") -> str:
    return stepped(source) + f""", usual AS (
  SELECT track_id, list_sort(list(step) FILTER (step IS NOT NULL)) AS sorted FROM steps GROUP BY track_id
), limits AS (
  SELECT track_id, sorted[len(sorted) // 2 + 1] AS usual, greatest(10 * sorted[len(sorted) // 2 + 1], 50) AS threshold FROM usual WHERE len(sorted) > 0
), jumps AS (
  SELECT *, seq - 1 AS index, seq - row_number() OVER ({W}) AS island FROM steps JOIN limits USING (track_id) WHERE step > threshold
), gaps AS (
  SELECT track_id, min(index) + 1 AS frame, sum(step) AS metres, count(*) AS spans, arg_min(p_lat, index) AS from_lat, arg_min(p_lng, index) AS from_lng, arg_max(lat, index) AS to_lat, arg_max(lng, index) AS to_lng
  FROM jumps GROUP BY track_id, island)"""


RUNS = f"""ok AS (SELECT * FROM zipped WHERE status = 'OK'),
marked AS (SELECT *, CASE WHEN lag(seq) OVER ({W}) IS NOT NULL AND pano_id IS DISTINCT FROM lag(pano_id) OVER ({W}) THEN 1 ELSE 0 END AS new FROM ok),
in_runs AS (SELECT * EXCLUDE (new), sum(new) OVER ({W}) AS run FROM marked)"""
BEST = RUNS + ", " + distance("errors", "in_runs", "lat", "lng", "pano_lat", "pano_lng", "err") + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY track_id, run ORDER BY err, seq) AS rank FROM errors),
best AS (SELECT * EXCLUDE (seq, rank), row_number() OVER (PARTITION BY track_id ORDER BY seq) - 1 AS seq FROM ranked WHERE rank = 1)"""

URLS = """urls AS (
  SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '?key=K' || page_id || '&a b=*~é' WHEN 1 THEN '?q=' || page_id || '&key=K' || page_id ELSE '' END AS url FROM pages
), parts AS (
  SELECT page_id, url, split_part(url, '?', 1) AS head, CASE WHEN contains(url, '?') THEN substr(url, strpos(url, '?') + 1) END AS query FROM urls
), stripped AS (
  SELECT page_id, url AS full_url, CASE WHEN query IS NULL THEN url ELSE
    head || CASE WHEN rest = '' THEN '' ELSE '?' || rest END END AS url
  FROM (SELECT *, array_to_string(list_filter(string_split(query, '&'), lambda p: NOT starts_with(p, 'key=')), '&') AS rest FROM parts)
), bytes AS (
  SELECT page_id, list_transform(range(octet_length(encode(url))), lambda i: ('0x' || substr(hex(encode(url)), 2 * i::INTEGER + 1, 2))::HUGEINT) AS b FROM stripped
), digests AS (
  SELECT page_id, lower(lpad(printf('%x', h), 16, '0')) AS digest FROM (
    SELECT page_id, list_reduce(list_prepend(14695981039346656037::HUGEINT, b), lambda h, x: (xor(h, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT AS h FROM bytes)
)"""

ENCODE = lambda d: f"(SELECT string_agg(chr((CASE WHEN (z >> (5 * (k + 1))) > 0 THEN 95 ELSE 63 END + ((z >> (5 * k)) & 31))::INTEGER), '' ORDER BY k) FROM (SELECT CASE WHEN {d} < 0 THEN -2 * {d} - 1 ELSE 2 * {d} END AS z), range(7) r(k) WHERE k = 0 OR (z >> (5 * k)) > 0)"

EDGES = """last AS (SELECT track_id, max(seq) AS last FROM points GROUP BY track_id),
band AS (SELECT a.track_id, a.seq AS i, b.seq AS j FROM points a JOIN points b ON a.track_id = b.track_id AND b.seq > a.seq AND b.seq <= a.seq + 4),
valued AS (SELECT track_id, i, j, floor(a.lat * 1e6) AS v_i, floor(b.lat * 1e6) AS v_j FROM band JOIN points a USING (track_id) JOIN points b USING (track_id) WHERE a.seq = i AND b.seq = j),
edges AS (SELECT track_id, i, j, CASE WHEN (v_i + v_j) % 900 < 400 THEN least(abs(v_i - v_j) % 700, (v_i + v_j) % 900) ELSE 400 END + 100.0::DOUBLE * (j - i - 1) * (j - i - 1) AS cost FROM valued)"""

PATHS = """ins AS (SELECT track_id, j, list({'i': i, 'c': cost} ORDER BY i) AS e FROM edges GROUP BY track_id, j),
solved AS (
  SELECT track_id, 0::BIGINT AS j, [0.0::DOUBLE] AS costs, [0::BIGINT] AS prevs FROM last
  UNION ALL
  SELECT track_id, j, list_append(costs, list_min(new)), list_append(prevs, e[list_position(new, list_min(new))].i)
  FROM (SELECT s.track_id, n.j, costs, prevs, n.e, list_transform(n.e, lambda x: x.c + costs[x.i + 1]) AS new FROM solved s JOIN ins n ON n.track_id = s.track_id AND n.j = s.j + 1)
), paths AS (
  SELECT s.track_id, s.j AS spot, [s.j] AS path, prevs, costs[-1] AS total FROM solved s JOIN last l ON l.track_id = s.track_id AND l.last = s.j WHERE s.j > 0
  UNION ALL
  SELECT track_id, prevs[spot + 1], list_prepend(prevs[spot + 1], path), prevs, total FROM paths WHERE spot > 0
)"""

DENSE = """plan AS (
  SELECT track_id, trunc(length / 1600)::BIGINT AS wanted, trunc(length / 1600)::BIGINT // (points - 1) + 1 AS factor FROM lengths WHERE points > 1
), led AS (
  SELECT p.*, wanted, factor, lead(lat) OVER v AS n_lat, lead(lng) OVER v AS n_lng FROM points p JOIN plan USING (track_id) WINDOW v AS (PARTITION BY track_id ORDER BY seq)
), angled AS (
  SELECT *, 2 * asin(least(1, sqrt(pow(sin((radians(n_lat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(n_lat)) * pow(sin(radians(n_lng - lng) / 2), 2)))) AS d FROM led
), shared AS (
  SELECT *, j::DOUBLE / factor AS u FROM angled, LATERAL (SELECT unnest(range(1, factor)) AS j) WHERE factor > 1 AND (lat <> n_lat OR lng <> n_lng)
), weighed AS (
  SELECT *, sin((1 - u) * d) / sin(d) AS a, sin(u * d) / sin(d) AS b FROM shared
), placed_d AS (
  SELECT track_id, seq, j, a * cos(radians(lat)) * cos(radians(lng)) + b * cos(radians(n_lat)) * cos(radians(n_lng)) AS x, a * cos(radians(lat)) * sin(radians(lng)) + b * cos(radians(n_lat)) * sin(radians(n_lng)) AS y, a * sin(radians(lat)) + b * sin(radians(n_lat)) AS z FROM weighed
), both_d AS (
  SELECT track_id, seq, j, degrees(atan2(z, sqrt(x * x + y * y))) AS lat, degrees(atan2(y, x)) AS lng FROM placed_d
  UNION ALL SELECT track_id, seq, 0, lat, lng FROM led WHERE factor < 2
), dense AS (
  SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY seq, j) - 1 AS seq, lat, lng, NULL::DOUBLE AS ele FROM both_d
)"""

FEATURES = "features AS (SELECT track_id, (seq // 6)::BIGINT AS seq, seq % 6 AS feature, floor(lat * 1e6 % 97)::BIGINT AS response, (floor(lat * 1e6)::BIGINT % 256) AS x, (floor(lng * -1e6)::BIGINT % 256) AS y FROM points)"

SETTINGS = """settings AS (
  SELECT percent::INTEGER AS percent, position, margin::INTEGER AS margin, greatest(1, 480 * percent // 100)::INTEGER AS size
  FROM range(1, 101) r(percent), (VALUES ('tl'), ('tr'), ('bl'), ('br')) p(position), (VALUES (0), (12), (300)) m(margin)
), placed AS (
  SELECT *, (CASE WHEN position IN ('tl', 'bl') THEN least(margin, greatest(0, 640 - size - margin)) ELSE greatest(0, 640 - size - margin) END)::INTEGER AS x,
         (CASE WHEN position IN ('tl', 'tr') THEN least(margin, greatest(0, 480 - size - margin)) ELSE greatest(0, 480 - size - margin) END)::INTEGER AS y,
         greatest(2.5::DOUBLE, size * 2 / 34.0::DOUBLE) AS r
  FROM settings
), padded AS (
  SELECT *, (ceil(ceil(r + greatest(1, r / 2.5::DOUBLE)) / 2))::INTEGER AS pad FROM placed
)"""


def text(number: str) -> str:
    return f"regexp_replace(({number})::VARCHAR, '\\.0$', '')"


def w(*ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join(ctes) + "\n"


def oracle_sql() -> dict[str, str]:
    tracks = (POINTS,)
    x, y = pixel("lat", "lng", "47.005::DOUBLE", "-121.8::DOUBLE", "10", 192)
    fx, fy = pixel("p.lat", "p.lng", "f.lat", "f.lng", "12", 192)
    chain = "CASE percent % 3 WHEN 0 THEN 'null' WHEN 1 THEN 'minterpolate=fps=48,tblend=all_mode=average,framestep=2' ELSE 'minterpolate=''mi_mode=mci:mc_mode=aobmc:vsbmc=1:fps=72''' END"
    half = "0.5::DOUBLE"
    ang = f"(2 * asin(least(1, sqrt(pow(sin((radians(n_lat) - radians(lat)) * {half}), 2) + cos(radians(lat)) * cos(radians(n_lat)) * pow(sin(radians(n_lng - lng) * {half}), 2)))))"
    return {
        "track_step_distance": w(*tracks, stepped()) + "SELECT track_id, seq, round(step, 3) AS step FROM steps WHERE step IS NOT NULL",
        "track_length": w(*tracks, stepped(), LENGTHS) + "SELECT track_id, round(length, 3) AS length, points FROM lengths",
        "track_running_distance": w(*tracks, stepped()) + f"SELECT track_id, seq, round(sum(coalesce(step, 0)) OVER ({W}), 3) AS running FROM steps",
        "track_bearing": w(*tracks, bearings("points")) + "SELECT track_id, seq, round(bearing, 6) AS bearing FROM bearings",
        "track_sample_even": w(*tracks, stepped(), sampled("20"), bearings("sampled")) + "SELECT track_id, seq, round(lat, 6) AS lat, round(lng, 6) AS lng, ele, round(bearing, 6) AS bearing FROM bearings",
        "track_expected_frames": w(*tracks, stepped(), LENGTHS) + "SELECT track_id, trunc(100 * length / 1600)::BIGINT AS frames FROM lengths",
        "track_densify_factor": w(*tracks, stepped(), LENGTHS) + "SELECT track_id, CASE WHEN points > 1 THEN (trunc(100 * length / 1600)::BIGINT // nullif(points - 1, 0) + 1)::INTEGER END AS factor, CASE WHEN points > 1 THEN 3 END AS given FROM lengths",
        "track_densify": w(*tracks, "n AS (SELECT *, lead(lat) OVER v AS n_lat, lead(lng) OVER v AS n_lng, lead(ele) OVER v AS n_ele FROM points WINDOW v AS (PARTITION BY track_id ORDER BY seq))", f"d AS (SELECT *, {ang} AS d FROM n WHERE lat <> n_lat OR lng <> n_lng)", "s AS (SELECT *, sin((1 - j / 3) * d) / sin(d) AS v, sin(j / 3 * d) / sin(d) AS u FROM d, (VALUES (1.0::DOUBLE), (2.0::DOUBLE)) t(j))", "c AS (SELECT *, v * cos(radians(lat)) * cos(radians(lng)) + u * cos(radians(n_lat)) * cos(radians(n_lng)) AS x, v * cos(radians(lat)) * sin(radians(lng)) + u * cos(radians(n_lat)) * sin(radians(n_lng)) AS y, v * sin(radians(lat)) + u * sin(radians(n_lat)) AS z FROM s)")
        + "SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY seq, j) - 1 AS seq, round(degrees(atan2(z, sqrt(x * x + y * y))), 6) AS lat, round(degrees(atan2(y, x)), 6) AS lng, round(ele + (n_ele - ele) * ((j - 1) / 3), 6) AS ele FROM c",
        "positional_zip": w(*tracks, LOOKUPS) + "SELECT track_id, seq, status, pano_id FROM zipped",
        "pano_filter_ok": w(*tracks, LOOKUPS) + "SELECT track_id, seq, pano_id FROM zipped WHERE status = 'OK'",
        "pano_rejected": w(*tracks, LOOKUPS) + "SELECT track_id, seq, status FROM zipped WHERE status <> 'OK'",
        "pano_runs": w(*tracks, LOOKUPS, RUNS) + "SELECT track_id, seq, run::BIGINT AS run, pano_id FROM in_runs",
        "pano_run_best": w(*tracks, LOOKUPS, BEST) + "SELECT track_id, seq, run::BIGINT AS run, pano_id, round(lat, 6) AS lat, round(lng, 6) AS lng, round(err, 3) AS err FROM best",
        "pano_summary": w(*tracks, TWO_OR_MORE, LOOKUPS.replace("FROM points JOIN", "FROM points_b JOIN"), BEST, stepped(), LENGTHS)
        + "SELECT track_id, round(length, 3) AS distance, frames, frames AS gps_points, points AS original_points, round(err, 3) AS average_error, 'track ' || track_id AS name, points * 32 AS file_size_bytes FROM (SELECT track_id, count(*) AS frames, avg(err) AS err FROM best GROUP BY track_id) JOIN lengths USING (track_id)",
        "summary_json": w(*tracks, TWO_OR_MORE, LOOKUPS.replace("FROM points JOIN", "FROM points_b JOIN"), BEST) + "SELECT track_id, count(*) AS frames, list(ele ORDER BY seq)[-1] AS last_ele, 'track ' || track_id AS name FROM best GROUP BY track_id",
        "gap_threshold": w(*tracks, gap_ctes()) + "SELECT track_id, round(usual, 3) AS usual, round(threshold, 3) AS threshold FROM limits",
        "gap_islands": w(*tracks, GAP_POINTS, gap_ctes("thin")) + "SELECT track_id, frame, round(metres, 3) AS metres, spans, round(from_lat, 6) AS from_lat, round(from_lng, 6) AS from_lng, round(to_lat, 6) AS to_lat, round(to_lng, 6) AS to_lng FROM gaps",
        "gap_timestamps": w(*tracks, GAP_POINTS, gap_ctes("thin")) + "SELECT track_id, frame, round(frame / 24, 6) AS seconds FROM gaps",
        "gap_report": w(*tracks, GAP_POINTS, gap_ctes("thin")) + "SELECT track_id, frame, printf('  %6.1fs  skips %5.0f m%s  https://www.google.com/maps/@%.6f,%.6f,17z', frame / 24, metres, CASE WHEN spans > 1 THEN ' over ' || spans || ' frames' ELSE '' END, from_lat, from_lng) AS line FROM gaps",
        "track_bbox": w(*tracks) + "SELECT track_id, round(max(lat), 6) AS north, round(min(lat), 6) AS south, round(max(lng), 6) AS east, round(min(lng), 6) AS west FROM points GROUP BY track_id",
        "track_framing": w(*tracks, "b AS (SELECT track_id, max(lat) AS n, min(lat) AS s, max(lng) AS e, min(lng) AS w FROM points GROUP BY track_id)") + f"SELECT track_id, round((n + s) / 2, 8) AS center_lat, round((e + w) / 2, 8) AS center_lng, {fit('n', 's', 'e', 'w', 192)} AS zoom FROM b",
        "mercator_pixel": w(*tracks) + f"SELECT track_id, seq, round({x0('lng')}, 6) AS x, round({y0('lat')}, 6) AS y FROM points",
        "image_pixel": w(*tracks) + f"SELECT track_id, seq, round(2 * {x}, 3) AS x, round(2 * {y}, 3) AS y FROM points",
        "fit_zoom": w(*tracks) + f"SELECT track_id, seq, {fit('(lat + (seq % 20) / 7)', 'lat', '(lng + (seq % 20) / 7 * 1.5::DOUBLE)', 'lng', 192)} AS zoom FROM points",
        "clip_visible": w(*tracks, clipped(10)) + "SELECT track_id, seq, visible, kept FROM kept",
        "clip_runs": w(*tracks, clipped(10)) + "SELECT track_id, run::INTEGER AS run, n, round(first_lng, 6) AS first_lng FROM numbered",
        "longest_runs": w(*tracks, clipped(13)) + "SELECT track_id, run::INTEGER AS run, n FROM numbered QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY n DESC, run) <= 2",
        "follow_view": w(*tracks, f"on_screen AS (SELECT f.track_id, f.seq AS frame, p.seq, {seen(fx, fy, 192)} AS s FROM points f JOIN points p USING (track_id))", "near AS (SELECT *, s OR coalesce(lag(s) OVER o, false) OR coalesce(lead(s) OVER o, false) AS k FROM on_screen WINDOW o AS (PARTITION BY track_id, frame ORDER BY seq))", "isl AS (SELECT *, seq - row_number() OVER (PARTITION BY track_id, frame ORDER BY seq) AS island FROM near WHERE k)") + "SELECT track_id, frame, count(DISTINCT island) AS runs, count(*) AS n FROM isl GROUP BY track_id, frame",
        "downsample_even_index": w(*tracks, "n AS (SELECT track_id, max(seq) AS last FROM points GROUP BY track_id)", "chosen AS (SELECT track_id, i, CASE WHEN last < 10 THEN i ELSE round(i * (last / 9))::BIGINT END AS seq FROM n, range(10) r(i) WHERE i <= last)") + "SELECT track_id, i, round(lat, 6) AS lat, round(lng, 6) AS lng FROM chosen JOIN points USING (track_id, seq)",
        "polyline_deltas": w(*tracks, "e AS (SELECT track_id, seq, round(lat * 100000)::BIGINT AS a, round(lng * 100000)::BIGINT AS b FROM points)") + f"SELECT track_id, seq, a - lag(a, 1, 0) OVER ({W}) AS d_lat, b - lag(b, 1, 0) OVER ({W}) AS d_lng FROM e",
        "polyline_encode": w(*tracks, "e AS (SELECT track_id, seq, round(lat * 100000)::BIGINT AS a, round(lng * 100000)::BIGINT AS b FROM points)", f"d AS (SELECT track_id, seq, a - lag(a, 1, 0) OVER ({W}) AS d_lat, b - lag(b, 1, 0) OVER ({W}) AS d_lng FROM e)", f"c AS (SELECT track_id, seq, {ENCODE('d_lat')} || {ENCODE('d_lng')} AS s FROM d)") + "SELECT track_id, string_agg(s, '' ORDER BY seq) AS polyline FROM c GROUP BY track_id",
        "url_strip_key": w(URLS) + "SELECT page_id, url FROM stripped",
        "url_redact_key": w(URLS) + r"SELECT page_id, regexp_replace('error for url (' || url || ') after 3 s', '(^|[?&])key=[^&)\s]*', '\1key=REDACTED', 'g') AS message FROM urls",
        "url_percent_encode": w(URLS) + "SELECT page_id, (SELECT string_agg(CASE WHEN regexp_full_match(c, '[A-Za-z0-9._~-]') THEN c ELSE regexp_replace(hex(encode(c)), '(..)', '%\\1', 'g') END, '' ORDER BY i) FROM (SELECT unnest(string_split(url, '')) AS c, generate_subscripts(string_split(url, ''), 1) AS i)) AS url FROM urls",
        "url_fnv1a": w(URLS) + "SELECT page_id, digest FROM digests",
        "cache_path": w(URLS) + "SELECT page_id, '/cache/' || CASE page_id % 3 WHEN 0 THEN 'streetview' WHEN 1 THEN 'map' ELSE 'metadata' END || '/' || substr(digest, 1, 2) || '/' || digest || '.' || CASE page_id % 3 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' ELSE 'json' END AS path FROM digests",
        "map_failure_message": w(URLS) + r"SELECT page_id, 'Minimap request failed: ' || regexp_replace('refused ' || url, '(^|[?&])key=[^&)\s]*', '\1key=REDACTED', 'g') || CASE WHEN page_id % 4 < 2 THEN chr(10) || 'The map API is probably not enabled for this key; it is separate from the imagery API.' ELSE '' END || chr(10) || 'Enable the Maps Static API at https://console.cloud.google.com/apis/library/static-maps-backend.googleapis.com' AS message FROM urls",
        "cache_hit_miss": w(URLS) + "SELECT page_id, url IN (SELECT url FROM stripped WHERE page_id % 2 = 0) AS hit FROM stripped",
        "frame_offset_limit": w(*tracks) + "SELECT track_id, seq - 5 AS seq, round(lat, 6) AS lat FROM points WHERE seq BETWEEN 5 AND 14",
        "frame_gather": w(*tracks, "m AS (SELECT track_id, max(seq) AS last FROM points GROUP BY track_id)", "k AS (SELECT track_id, 0 AS n, last AS f FROM m UNION ALL SELECT track_id, 1, 0 FROM m UNION ALL SELECT track_id, 2, last // 2 FROM m)") + "SELECT k.track_id, k.n::BIGINT AS seq, round(p.lat, 6) AS lat FROM k JOIN points p ON p.track_id = k.track_id AND p.seq = k.f",
        "frame_band_pairs": w(*tracks, EDGES) + "SELECT track_id, i, j FROM band",
        "frame_edge_cost": w(*tracks, EDGES) + "SELECT track_id, i, j, cost FROM edges",
        "frame_best_path": w(*tracks, EDGES, PATHS) + "SELECT track_id, array_to_string(path, ',') AS kept, total FROM paths WHERE spot = 0",
        "request_urls": w(*tracks, bearings("points"), f"t AS (SELECT track_id, seq, {text('floor(lat * 10000) / 10000')} AS a, {text('floor(lng * 10000) / 10000')} AS b, {text('floor(bearing * 10) / 10')} AS h FROM bearings)") + "SELECT track_id, seq, 'https://maps.googleapis.com/maps/api/streetview?size=640x480&location=' || a || ',' || b || '&fov=100&source=outdoor&heading=' || h || '&pitch=0&key=SECRET' AS image, 'https://maps.googleapis.com/maps/api/streetview/metadata?location=' || a || ',' || b || '&source=outdoor&key=SECRET' AS lookup FROM t",
        "lookup_parse": w(*tracks, "r AS (SELECT track_id, seq, floor(lat * 10000) / 10000 AS lat, floor(lng * 10000) / 10000 AS lng FROM points)") + "SELECT track_id, seq, CASE WHEN lat < 47.01::DOUBLE THEN 'OK' ELSE 'ZERO_RESULTS' END AS status, CASE WHEN lat < 47.01::DOUBLE THEN '2024-01' ELSE '' END AS date, CASE WHEN lat < 47.01::DOUBLE THEN lat ELSE 0 END AS pano_lat, CASE WHEN lat < 47.01::DOUBLE THEN lng ELSE 0 END AS pano_lng FROM r",
        "route_samples": w(*tracks, stepped(), LENGTHS, DENSE, stepped("dense").replace("pairs", "pairs_d").replace("steps", "steps_d"), "wanted_d AS (SELECT s.*, wanted FROM steps_d s JOIN plan USING (track_id))", sampled("wanted", "wanted_d"), "l AS (SELECT track_id, sum(step) AS length, count(*) AS points FROM steps_d GROUP BY track_id)") + "SELECT track_id, count(*) AS frames, round(any_value(length), 3) AS length, any_value(points) AS points FROM sampled JOIN l USING (track_id) GROUP BY track_id HAVING count(*) > 1",
        "frame_top_features": w(*tracks, FEATURES) + "SELECT track_id, seq, feature, response FROM features QUALIFY row_number() OVER (PARTITION BY track_id, seq ORDER BY response DESC, feature) <= 3",
        "frame_feature_matches": w(*tracks, FEATURES) + """, away AS (
  SELECT a.track_id, a.seq AS i, b.seq AS j, a.feature, b.feature AS nearest, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))::DOUBLE AS distance
  FROM features a JOIN features b ON a.track_id = b.track_id AND b.seq > a.seq AND b.seq <= a.seq + 4
), two AS (SELECT *, row_number() OVER o AS k, lead(distance) OVER o AS second FROM away WINDOW o AS (PARTITION BY track_id, i, j, feature ORDER BY distance, nearest))
SELECT track_id, i, j, feature, nearest, round(distance, 6) AS distance FROM two WHERE k = 1 AND distance < 0.75 * second""",
        "frame_number": "SELECT page_id, ('7' || page_id)::BIGINT AS number FROM pages",
        "lines_union": w(*tracks) + "SELECT track_id, count(*) + count(*) FILTER (seq % 2 = 0) AS n FROM points GROUP BY track_id",
        "overlay_offsets": w(SETTINGS) + "SELECT percent, position, margin, size, x, y FROM placed",
        "overlay_geometry": w(SETTINGS) + "SELECT percent, position, margin, (x - pad)::INTEGER AS x, (y - pad)::INTEGER AS y, (size + 2 * pad)::INTEGER AS padded FROM padded",
        "filter_graph": w(SETTINGS) + f"SELECT percent, position, '[0:v]' || {chain} || CASE WHEN percent % 5 = 0 THEN '[out]' ELSE '[base];[1:v]scale=' || (size + 2 * pad) || ':' || (size + 2 * pad) || '[map];[base][map]overlay=' || (x - pad) || ':' || (y - pad) || '[out]' END AS graph, round(CASE WHEN percent % 3 < 2 THEN 100.0::DOUBLE ELSE 33.3::DOUBLE END * percent / 100, 6) AS progress FROM padded WHERE margin = 12",
    }
