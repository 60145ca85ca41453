"""The same answers in plain SQL for DuckDB.

The roads of the views are meridians, so the spanning tree of a stretch is the line through its
positions: ``lag`` finds the gaps and latitude gives the chainage. The Spark side runs the real tree.
"""

from __future__ import annotations

from kerbline.operators.ranks import POISSON_CUTS
from workload import views

_K = "(pi() * 6371008.8e0 / 180e0)"
_F0, _F1 = views.FEATURE_YEARS
_T0, _T1 = views.TARGET_YEARS
_IN_F = f"year(occurred_on) BETWEEN {_F0} AND {_F1}"
_IN_T = f"year(occurred_on) BETWEEN {_T0} AND {_T1}"


def _dominant(column: str) -> str:
    return f"""(SELECT segment_id, {column} AS v FROM (
        SELECT segment_id, {column}, row_number() OVER (PARTITION BY segment_id ORDER BY count(*) DESC, {column}) AS rn
        FROM window_crash GROUP BY segment_id, {column}) q WHERE rn = 1)"""


# name -> SQL; later views may use earlier ones
_VIEWS = {
    "collision": views.COLLISION,
    "collision_n": views.COLLISION_WITH_UNNUMBERED,
    "casualty": views.CASUALTY,
    "vehicle": views.VEHICLE,
    "manifest": views.MANIFEST,
    "severity_map": views.SEVERITY_MAP,
    "contribution": views.CONTRIBUTION,
    "csv_lines": views.CSV_LINES,
    "route_ends": views.ROUTE_ENDS,
    "ksi": """SELECT collision_id, count(*) AS n_casualties, count(*) FILTER (severity = 'fatal') AS n_fatal,
        count(*) FILTER (severity = 'serious') AS n_serious, count(*) FILTER (severity = 'slight') AS n_slight,
        count(*) FILTER (severity IN ('fatal', 'serious')) AS ksi FROM casualty GROUP BY collision_id""",
    "crash": """SELECT c.*, coalesce(n_casualties, 0) AS n_casualties, coalesce(n_fatal, 0) AS n_fatal, coalesce(n_serious, 0) AS n_serious,
        coalesce(n_slight, 0) AS n_slight, coalesce(ksi, 0) AS ksi, coalesce(n_vehicles, 0) AS n_vehicles
        FROM collision c LEFT JOIN ksi USING (collision_id)
        LEFT JOIN (SELECT collision_id, count(*) AS n_vehicles FROM vehicle GROUP BY collision_id) v USING (collision_id)""",
    "pos": "SELECT road_number, lon, lat, min(collision_id) AS pos_id, count(*) AS n_here FROM collision GROUP BY road_number, lon, lat",
    "gaps": "SELECT *, lat - lag(lat) OVER (PARTITION BY road_number ORDER BY lat) AS step FROM pos",
    "runs": f"""SELECT *, CAST(1 + sum(CASE WHEN round(step * {_K}, 3) > 5000 THEN 1 ELSE 0 END)
        OVER (PARTITION BY road_number ORDER BY lat ROWS UNBOUNDED PRECEDING) AS INT) AS run FROM gaps""",
    "chained": f"""SELECT *, (lat - min(lat) OVER (PARTITION BY road_number, run)) * {_K} AS chainage,
        (max(lat) OVER (PARTITION BY road_number, run) - min(lat) OVER (PARTITION BY road_number, run)) * {_K} AS stretch_m FROM runs""",
    "placed": """SELECT *, CAST(floor(round(chainage, 3) / 500) AS INT) AS block, floor(round(chainage, 3) / 500) * 0.5e0 AS km,
        printf('%s_run%d_km%.1f', road_number, run, floor(round(chainage, 3) / 500) * 0.5e0) AS segment_id FROM chained""",
    "assigned": """SELECT c.*, p.segment_id, p.run, p.block, p.km, p.chainage, p.stretch_m
        FROM crash c JOIN placed p ON c.road_number = p.road_number AND c.lat = p.lat""",
    "window_crash": f"SELECT * FROM assigned WHERE {_IN_F}",
    "seg": f"""SELECT segment_id, road_number, run, km, avg(lon) AS lon, avg(lat) AS lat, count(*) AS n_crashes, count(*) / 4.0e0 AS score,
        CAST(coalesce(sum(ksi) FILTER ({_IN_T}), 0) AS BIGINT) AS ksi_target, count(*) FILTER ({_IN_F}) AS f_crashes
        FROM assigned GROUP BY segment_id, road_number, run, km""",
    "feat": f"""SELECT segment_id, count(*) AS f_crashes, CAST(sum(ksi) AS BIGINT) AS f_ksi, CAST(sum(n_fatal) AS BIGINT) AS f_fatal,
        CAST(sum(n_serious) AS BIGINT) AS f_serious, CAST(sum(n_slight) AS BIGINT) AS f_slight,
        round(sum(n_casualties) / count(*), 6) AS f_casualties_per_crash, round(sum(n_vehicles) / count(*), 6) AS f_vehicles_per_crash,
        count(*) FILTER (year(occurred_on) = {_F0}) AS f_year1, count(*) FILTER (year(occurred_on) = {_F0 + 1}) AS f_year2,
        count(*) FILTER (year(occurred_on) = {_F0 + 2}) AS f_year3,
        round(avg(speed_limit), 6) AS f_speed_mean, round(avg(CASE WHEN junction_type <> 'none' THEN 1e0 ELSE 0e0 END), 6) AS f_junction_share,
        round(avg(CASE WHEN is_urban THEN 1e0 WHEN NOT is_urban THEN 0e0 END), 6) AS f_urban_share,
        round(avg(CASE WHEN lighting = 'dark_unlit' THEN 1e0 ELSE 0e0 END), 6) AS f_unlit_share,
        round(avg(CASE WHEN hour >= 19 OR hour < 7 THEN 1e0 ELSE 0e0 END), 6) AS f_night_share,
        round(avg(lon), 7) AS f_lon, round(avg(lat), 7) AS f_lat, round(max(chainage) - min(chainage), 2) AS f_extent_m,
        min(block) * 500e0 AS f_start_m, round(coalesce(min(block) * 500e0 / nullif(max(stretch_m), 0), 0), 6) AS f_position_share,
        round(max(stretch_m), 2) AS f_stretch_m FROM window_crash GROUP BY segment_id""",
    "known": "SELECT * FROM seg WHERE f_crashes > 0",
    "cut": """SELECT quantile_cont(score, 0.5) AS elevated, quantile_cont(score, 0.8) AS severe, quantile_cont(score, 0.95) AS critical, max(score) AS top
        FROM seg WHERE n_crashes >= 6""",
    "tiered": """SELECT seg.*, CASE WHEN elevated IS NULL THEN NULL WHEN score < elevated THEN 'Watch' WHEN score < severe THEN 'Elevated' WHEN score < critical THEN 'Severe' ELSE 'Critical' END AS tier,
        CAST(CASE WHEN elevated IS NULL THEN NULL WHEN score < elevated THEN least(24, floor(25 * score / elevated))
             WHEN score < severe THEN least(49, floor(25 + 25 * (score - elevated) / (severe - elevated)))
             WHEN score < critical THEN least(74, floor(50 + 25 * (score - severe) / (critical - severe)))
             ELSE least(100, floor(75 + 25 * (score - critical) / (top - critical))) END AS INT) AS display FROM seg JOIN cut ON true""",
    "speed_mode": f"SELECT segment_id, v AS f_speed_mode FROM {_dominant('speed_limit')} d",
    # routes: straight north beside one road; positions along them are latitude differences
    "route": f"""SELECT request_id, candidate, lon, lat0, lat1, (lat1 - lat0) * {_K} AS distance_m, (lat1 - lat0) * {_K} / (12 + candidate) AS duration_s FROM route_ends""",
    "match": f"""SELECT request_id, candidate, segment_id, score, d AS distance_m, greatest(0, least(lat1 - lat0, lat - lat0)) * {_K} AS position_m
        FROM (SELECT r.*, s.segment_id, s.score, s.lat,
                sqrt(power((s.lon - r.lon) * cos(radians(s.lat)) * {_K}, 2) + power((s.lat - greatest(lat0, least(lat1, s.lat))) * {_K}, 2)) AS d
              FROM route r JOIN (SELECT * FROM seg WHERE n_crashes >= 6) s ON s.lon BETWEEN r.lon - 2e-2 AND r.lon + 2e-2
                AND s.lat BETWEEN r.lat0 - 2e-2 AND r.lat1 + 2e-2) x WHERE d <= 50""",
    "total": """SELECT r.request_id, r.candidate, r.distance_m, r.duration_s, coalesce(sum(m.score), 0e0) AS expected_ksi, count(m.segment_id) AS blackspot_count,
        first(m.segment_id ORDER BY m.score DESC, m.segment_id) AS worst_segment_id,
        coalesce(string_agg(m.segment_id, ',' ORDER BY m.position_m, m.segment_id), '') AS in_order
        FROM route r LEFT JOIN match m ON r.request_id = m.request_id AND r.candidate = m.candidate
        GROUP BY r.request_id, r.candidate, r.distance_m, r.duration_s""",
    "sample": f"""SELECT request_id, candidate, lon, lat0 + k * 500e0 / {_K} AS lat, k FROM (
        SELECT *, unnest(range(0, CAST(ceil(round(distance_m / 500, 6)) AS INT))) AS k FROM route) x""",
    "cover": f"""SELECT a.request_id, a.candidate, count(DISTINCT a.k) AS samples, count(DISTINCT CASE WHEN s.lat IS NOT NULL THEN a.k END) AS covered
        FROM sample a LEFT JOIN seg s ON s.lon BETWEEN a.lon - 2e-2 AND a.lon + 2e-2 AND s.lat BETWEEN a.lat - 1e-2 AND a.lat + 1e-2
          AND sqrt(power((s.lon - a.lon) * cos(radians(s.lat)) * {_K}, 2) + power((s.lat - a.lat) * {_K}, 2)) <= 500
        GROUP BY a.request_id, a.candidate""",
    # the odd cases: no path, and trips over 100 km
    "odd": f"""SELECT request_id, candidate, CASE WHEN request_id % 17 = 0 THEN 'no_route' ELSE 'ok' END AS status,
        (CASE WHEN request_id % 17 = 0 THEN 0e0 ELSE distance_m END) + CASE WHEN request_id % 13 = 0 THEN 12e4 ELSE 0e0 END AS distance_m FROM route""",
    "odd_kept": """SELECT *, distance_m / (12 + candidate) AS duration_s FROM (
        SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY distance_m / (12 + candidate), candidate) AS rn,
          first_value(distance_m) OVER (PARTITION BY request_id ORDER BY distance_m / (12 + candidate), candidate) AS best_m FROM odd) x
        WHERE rn <= CASE WHEN best_m > 100000 THEN 1 ELSE 3 END""",
    "leaves": """SELECT segment_id, avg(ksi_target) OVER () AS base, avg(ksi_target) OVER (PARTITION BY f_crashes >= 3) AS g FROM known""",
    "md5_order": """SELECT collision_id, CASE WHEN ksi > 0 THEN 1 ELSE 0 END AS severe, cast('0x' || substr(md5(CAST(collision_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM assigned""",
}

_LABEL = """CASE WHEN f AND s THEN 'Fastest and safest' WHEN f THEN 'Fastest' WHEN s THEN 'Safest' ELSE 'Alternative' END"""


def _label(src: str) -> str:
    return f"""(SELECT request_id, candidate, {_LABEL} AS label FROM (
        SELECT request_id, candidate, row_number() OVER (PARTITION BY request_id ORDER BY duration_s, candidate) = 1 AS f,
               row_number() OVER (PARTITION BY request_id ORDER BY expected_ksi, candidate) = 1 AS s FROM {src}) y)"""


def _captured(score: str) -> str:
    return f"""(SELECT sum(ksi_target) FILTER (rn <= ceil(round(0.2 * n, 9))) / sum(ksi_target) AS v, max(n) AS n, max(ceil(round(0.2 * n, 9))) AS k FROM (
        SELECT ksi_target, row_number() OVER (ORDER BY {score} DESC, segment_id) AS rn, count(*) OVER () AS n FROM known) q)"""


# bootstrap replicates: weights by md5 of replicate and segment
_WEIGHTS = f"""(SELECT k.*, r AS replicate, len(list_filter({POISSON_CUTS}, lambda c: cast('0x' || substr(md5(r || ':' || segment_id), 1, 8) AS BIGINT) >= c)) AS w
    FROM known k, range(1, 201) x(r))"""


def _replicates(score: str) -> str:
    return f"""(SELECT replicate, sum(w * ksi_target) FILTER (up <= most) / nullif(sum(w * ksi_target), 0) AS v FROM (
        SELECT *, sum(w) OVER (PARTITION BY replicate ORDER BY {score} DESC, segment_id ROWS UNBOUNDED PRECEDING) AS up,
          ceil(round(0.2 * sum(w) OVER (PARTITION BY replicate), 9)) AS most FROM {_WEIGHTS} q) q GROUP BY replicate)"""


# inputs of a few values, for models that SQL can fit
_FEW = "(SELECT segment_id, ksi_target::DOUBLE AS y, least(f_crashes, 6)::DOUBLE AS a, least(f_ksi, 4)::DOUBLE AS b FROM known JOIN feat USING (segment_id, f_crashes))"


def _trees(rounds: int, depth: int, rate: str, least: int) -> str:
    """Boosting in SQL: each level's sums by node, input and value, the best split of each node, and the rows moved."""
    out = [f"s0 AS (SELECT *, ln(avg(y) OVER ()) AS f, 0 AS node FROM {_FEW} q)"]
    at = "s0"
    for r in range(rounds):
        for d in range(depth):
            x = f"{r}_{d}"
            out.append(f"""v{x} AS (SELECT node, i, v, count(*) AS n, sum(y - exp(f)) AS g, sum(exp(f)) AS h FROM (
                SELECT node, y, f, 0 AS i, a AS v FROM {at} UNION ALL SELECT node, y, f, 1, b FROM {at}) q GROUP BY ALL)""")
            out.append(f"""c{x} AS (SELECT node, i, v, sum(n) OVER l AS nl, sum(g) OVER l AS gl, sum(h) OVER l AS hl, sum(n) OVER t AS n, sum(g) OVER t AS g, sum(h) OVER t AS h
                FROM v{x} WINDOW l AS (PARTITION BY node, i ORDER BY v), t AS (PARTITION BY node, i))""")
            out.append(f"""b{x} AS (SELECT node, i, v FROM (SELECT *, gl * gl / hl + (g - gl) * (g - gl) / (h - hl) - g * g / h AS gain FROM c{x} WHERE nl >= {least} AND n - nl >= {least}) q
                WHERE gain > greatest(1, h) * 1e-12 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, i, v) = 1)""")
            out.append(f"""m{x} AS (SELECT segment_id, y, a, b, f, CASE WHEN c.i IS NULL THEN node ELSE 2 * node + CASE WHEN CASE c.i WHEN 0 THEN a ELSE b END <= c.v THEN 1 ELSE 2 END END AS node
                FROM {at} LEFT JOIN b{x} c USING (node))""")
            at = f"m{x}"
        out.append(f"s{r + 1} AS (SELECT segment_id, y, a, b, f + {rate} * sum(y - exp(f)) OVER (PARTITION BY node) / sum(exp(f)) OVER (PARTITION BY node) AS f, 0 AS node FROM {at})")
        at = f"s{r + 1}"
    return f"SELECT segment_id, round(exp(f), 6) AS score FROM (WITH {', '.join(out)} SELECT * FROM {at}) q"


def _least_squares(steps: int) -> str:
    """Reweighted least squares in SQL on an intercept and two inputs, each system solved by Cramer's rule."""
    out = [f"r AS (SELECT * FROM {_FEW} q)", "k0 AS (SELECT ln(avg(y)) AS p, 0e0 AS q, 0e0 AS s FROM r)"]
    det = lambda m: f"({m[0]} * ({m[4]} * {m[8]} - {m[5]} * {m[7]}) - {m[1]} * ({m[3]} * {m[8]} - {m[5]} * {m[6]}) + {m[2]} * ({m[3]} * {m[7]} - {m[4]} * {m[6]}))"
    x = ["w", "wa", "wb", "wa", "waa", "wab", "wb", "wab", "wbb"]
    for i in range(steps):
        solved = [f"{det([('z' + 'xab'[j // 3]) if j % 3 == c else x[j] for j in range(9)])} / {det(x)} AS {n}" for c, n in enumerate("pqs")]
        out.append(f"""k{i + 1} AS (SELECT {', '.join(solved)} FROM (SELECT sum(m) AS w, sum(m * a) AS wa, sum(m * b) AS wb, sum(m * a * a) AS waa, sum(m * a * b) AS wab, sum(m * b * b) AS wbb,
            sum(m * e + y - m) AS zx, sum((m * e + y - m) * a) AS za, sum((m * e + y - m) * b) AS zb
            FROM (SELECT *, exp(e) AS m FROM (SELECT r.*, p + q * a + s * b AS e FROM r, k{i}) t) t) t)""")
    return f"SELECT segment_id, round(exp(p + q * a + s * b), 6) AS score FROM (WITH {', '.join(out)} SELECT * FROM r, k{steps}) t"


# history of a segment in the three years before a crash; ``h`` are its crashes then
_ROLLING = {
    "f_crashes": "count(h.collision_id)",
    **{f: f"CAST(sum(h.{c}) AS BIGINT)" for f, c in (("f_ksi", "ksi"), ("f_fatal", "n_fatal"), ("f_serious", "n_serious"), ("f_slight", "n_slight"))},
    "f_casualties_per_crash": "round(avg(h.n_casualties), 6)",
    "f_vehicles_per_crash": "round(avg(h.n_vehicles), 6)",
    "f_speed_mean": "round(avg(h.speed_limit), 6)",
    "f_urban_share": "round(avg(CASE WHEN h.is_urban THEN 1e0 WHEN NOT h.is_urban THEN 0e0 END), 6)",
    "f_unlit_share": "round(avg(CASE WHEN h.lighting = 'dark_unlit' THEN 1e0 WHEN h.lighting <> 'dark_unlit' THEN 0e0 END), 6)",
    "f_night_share": "round(avg(CASE WHEN h.hour >= 19 OR h.hour < 7 THEN 1e0 WHEN h.hour < 19 THEN 0e0 END), 6)",
}

_FINAL = {
    "completeness": """SELECT 'collision' AS kind, year, coalesce(n, 0) AS n, expected, CASE WHEN expected IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'missing'
        WHEN n < expected THEN 'short' WHEN n > expected THEN 'long' ELSE 'complete' END AS status
        FROM (SELECT CAST(year(occurred_on) AS INT) AS year, count(*) AS n FROM collision GROUP BY 1) h
        FULL JOIN (SELECT year, expected_rows AS expected FROM manifest) m USING (year)""",
    "completeness_children": """SELECT 'vehicle' AS kind, year, coalesce(n, 0) AS n, expected, CASE WHEN expected IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'missing'
        WHEN n < expected THEN 'short' WHEN n > expected THEN 'long' ELSE 'complete' END AS status
        FROM (SELECT CAST(year(occurred_on) AS INT) AS year, count(*) AS n FROM vehicle LEFT JOIN collision USING (collision_id) GROUP BY 1) h
        FULL JOIN (SELECT year, expected_rows * 3 AS expected FROM manifest) m USING (year)
        UNION ALL SELECT 'casualty' AS kind, year, coalesce(n, 0) AS n, expected, CASE WHEN expected IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'missing'
        WHEN n < expected THEN 'short' WHEN n > expected THEN 'long' ELSE 'complete' END AS status
        FROM (SELECT CAST(year(occurred_on) AS INT) AS year, count(*) AS n FROM casualty LEFT JOIN collision USING (collision_id) GROUP BY 1) h
        FULL JOIN (SELECT year, expected_rows * 4 AS expected FROM manifest) m USING (year)""",
    "rejected": r"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN road_number IS NULL OR NOT regexp_full_match(road_number, '[MAB][0-9]+(\(M\))?') THEN 'no numbered road'
        WHEN collision_id % 20 = 0 THEN 'coordinates missing' WHEN collision_id % 20 = 1 THEN 'coordinates swapped' WHEN collision_id % 20 = 2 THEN 'coordinates outside' END AS reason
        FROM collision_n) r WHERE reason IS NOT NULL GROUP BY reason""",
    "orphans": "SELECT collision_id, casualty_no, severity FROM casualty WHERE collision_id NOT IN (SELECT collision_id FROM collision_n WHERE road_number IS NOT NULL)",
    "coord_guard": """SELECT CASE collision_id % 20 WHEN 0 THEN 'missing' WHEN 1 THEN 'swapped' WHEN 2 THEN 'outside' ELSE 'ok' END AS coord_status,
        count(*) AS n, min(collision_id) AS first_id FROM collision GROUP BY 1""",
    "leak_guard": f"""SELECT max(occurred_on) FILTER ({_IN_F}) AS last_feature_date, min(occurred_on) FILTER ({_IN_T}) AS first_target_date,
        max(occurred_on) FILTER ({_IN_F}) < min(occurred_on) FILTER ({_IN_T}) AS clean FROM collision""",
    "severity_map": """SELECT c.severity_raw, coalesce(m.label, c.severity_raw) AS severity, count(*) AS n, round(sum(coalesce(m.weight, 1e0)), 3) AS weight
        FROM collision c LEFT JOIN severity_map m ON m.year = year(c.occurred_on) AND m.raw = c.severity_raw GROUP BY 1, 2""",
    "severity_drift": """SELECT year, severity, n, round(share, 6) AS share, round(share - lag(share) OVER (PARTITION BY severity ORDER BY year), 6) AS change FROM (
        SELECT CAST(year(occurred_on) AS INT) AS year, severity_raw AS severity, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY year(occurred_on)) AS share
        FROM collision GROUP BY year(occurred_on), severity_raw) d""",
    "numbered_roads": r"SELECT collision_id, road_number FROM collision_n WHERE regexp_full_match(road_number, '[MAB][0-9]+(\(M\))?')",
    "year_window": f"SELECT collision_id, CAST(year(occurred_on) AS INT) AS year, road_number FROM collision WHERE {_IN_F}",
    "evidenced": "SELECT segment_id, n_crashes FROM seg WHERE n_crashes >= 6",
    "bbox": "SELECT segment_id, n_crashes FROM seg WHERE lon BETWEEN -3.55 AND -2.05 AND lat BETWEEN 50.02 AND 50.11",
    "min_score": "SELECT segment_id, score FROM seg WHERE score >= 1.5",
    "rank_search": "SELECT segment_id, n_crashes FROM seg WHERE contains(lower(segment_id), 'a12_run2')",
    "search_index": "SELECT segment_id, n_crashes FROM seg WHERE contains(lower(segment_id), 'a12_run2')",
    "density_pyramid": """SELECT CAST(level AS INT) AS level, CAST(floor(x / pow(2, level)) AS BIGINT) AS cell_x, CAST(floor(y / pow(2, level)) AS BIGINT) AS cell_y, sum(w) AS weight FROM (
        SELECT floor(lon / 7e-2) + dx AS x, floor(lat / 7e-2) + dy AS y, score * (2 - abs(dx)) * (2 - abs(dy)) / 16e0 AS w FROM seg, range(-1, 2) a(dx), range(-1, 2) b(dy)) q, range(0, 5) l(level)
        GROUP BY ALL""",
    "explore": """SELECT segment_id, tier, f_speed_mode FROM tiered JOIN speed_mode USING (segment_id)
        WHERE tier IN ('Severe', 'Critical') AND road_number IN ('A3', 'A7', 'A21', 'A38') AND f_speed_mode IN (20, 40, 70)""",
    "ksi": "SELECT * FROM ksi",
    "crash_join": "SELECT collision_id, road_number, n_casualties, n_fatal, n_serious, n_slight, ksi, n_vehicles FROM crash",
    "haversine": """SELECT request_id, candidate, round(2 * 6371008.8e0 * asin(sqrt(power(sin(radians(lat1 - lat0) / 2), 2)
        + cos(radians(lat0)) * cos(radians(lat1)) * power(sin(radians(lon + 5e-2 - lon) / 2), 2))), 3) AS distance_m FROM route_ends""",
    "near_pairs_within_10m": f"""SELECT least(a.pos_id, b.pos_id) AS a, greatest(a.pos_id, b.pos_id) AS b, round((b.lat - a.lat) * {_K}, 3) AS distance_m
        FROM pos a JOIN pos b ON a.road_number = b.road_number AND b.lat > a.lat AND round((b.lat - a.lat) * {_K}, 3) <= 10""",
    "stretches": "SELECT road_number, run, count(*) AS positions, round(max(stretch_m), 2) AS stretch_m FROM placed GROUP BY road_number, run",
    "mst_weight": """SELECT road_number, run, count(*) - 1 AS edges, round(max(stretch_m), 2) AS total_m FROM placed
        GROUP BY road_number, run HAVING count(*) > 1""",
    "mst_extended": """SELECT road_number, run, count(*) - 1 AS edges, round(max(stretch_m), 2) AS total_m FROM placed
        GROUP BY road_number, run HAVING count(*) > 1""",
    "road_quantiles": """SELECT r AS road_number, share, count(*) AS n, true AS within
        FROM (SELECT unnest([road_number, 'all']) AS r FROM seg) s, (VALUES (5e-1), (8e-1), (95e-2)) p(share) GROUP BY r, share""",
    "chainage": "SELECT pos_id, road_number, run, round(chainage, 2) AS chainage FROM placed",
    "blocks": "SELECT road_number, run, block, count(*) AS positions, CAST(sum(n_here) AS BIGINT) AS crashes FROM placed GROUP BY road_number, run, block",
    "segment_ids": "SELECT segment_id, road_number, run, km FROM seg",
    "assign": "SELECT collision_id, segment_id FROM assigned",
    "n_crashes": "SELECT segment_id, n_crashes, round(lon, 7) AS lon, round(lat, 7) AS lat FROM seg",
    "f_history": """SELECT segment_id, f_crashes, f_ksi, f_fatal, f_serious, f_slight, f_casualties_per_crash, f_vehicles_per_crash, f_year1, f_year2, f_year3 FROM feat""",
    "f_speed": "SELECT segment_id, f_speed_mode, f_speed_mean FROM feat JOIN speed_mode USING (segment_id)",
    "f_category": f"""SELECT f.segment_id, r.v AS f_road_type, j.v AS f_junction_type, f_junction_share FROM feat f
        JOIN {_dominant('road_type')} r ON r.segment_id = f.segment_id JOIN {_dominant('junction_type')} j ON j.segment_id = f.segment_id""",
    "f_environment": "SELECT segment_id, f_urban_share, f_unlit_share FROM feat",
    "f_night": "SELECT segment_id, f_night_share FROM feat",
    "f_location": "SELECT segment_id, f_lon, f_lat, f_extent_m FROM feat",
    "f_position": "SELECT segment_id, f_start_m, f_position_share, f_stretch_m FROM feat",
    "target": f"SELECT segment_id, CAST(sum(ksi) AS BIGINT) AS ksi_target FROM assigned WHERE {_IN_T} GROUP BY segment_id",
    "features_target": """SELECT f.segment_id, f.f_crashes, f.f_ksi, f_speed_mode, f_night_share, ksi_target
        FROM feat f JOIN speed_mode USING (segment_id) JOIN seg s ON s.segment_id = f.segment_id""",
    "segment_build": f"""SELECT s.segment_id, s.road_number, s.run, s.km, s.n_crashes, f.* EXCLUDE (segment_id), m.f_speed_mode, r.v AS f_road_type, j.v AS f_junction_type, s.ksi_target
        FROM seg s LEFT JOIN feat f ON f.segment_id = s.segment_id LEFT JOIN speed_mode m ON m.segment_id = s.segment_id
        LEFT JOIN {_dominant('road_type')} r ON r.segment_id = s.segment_id LEFT JOIN {_dominant('junction_type')} j ON j.segment_id = s.segment_id""",
    "top_segments": "SELECT segment_id, n_crashes, score FROM seg WHERE n_crashes >= 6 ORDER BY score DESC, segment_id LIMIT 500",
    "rankings": "SELECT segment_id, n_crashes, score FROM seg WHERE n_crashes >= 6 ORDER BY score DESC, segment_id LIMIT 2000",
    "rankings_by": "SELECT segment_id, ksi_target FROM seg WHERE n_crashes >= 6 ORDER BY score DESC, segment_id LIMIT 2000",
    "top_json_rows": "SELECT segment_id, n_crashes, score FROM seg ORDER BY score DESC, segment_id LIMIT 500",
    "json_rows": """SELECT segment_id, CAST(json_object('segment_id', segment_id, 'n_crashes', n_crashes, 'ksi_target', ksi_target) AS VARCHAR) AS body FROM seg""",
    "ranked": "SELECT row_number() OVER (ORDER BY score DESC, segment_id) AS rank, segment_id, score FROM seg",
    "cutoffs": "SELECT round(elevated, 6) AS elevated, round(severe, 6) AS severe, round(critical, 6) AS critical, top FROM cut",
    "tiers": """SELECT segment_id, tier, CASE WHEN score < 0.94 THEN 'Watch' WHEN score < 1.57 THEN 'Elevated' WHEN score < 3.09 THEN 'Severe' ELSE 'Critical' END AS published_tier
        FROM tiered""",
    "tier_colours": """SELECT tier, CASE WHEN tier IS NULL THEN NULL WHEN tier = 'Severe' THEN 'Spectrum Red' WHEN tier = 'Critical' THEN 'Aconite Violet' ELSE 'Orange Yellow' END AS tier_colour, count(*) AS n
        FROM tiered GROUP BY tier""",
    "display": "SELECT segment_id, score, display FROM tiered",
    "tier_dist": "SELECT tier, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM tiered WHERE n_crashes >= 6 GROUP BY tier",
    "speed_breakdown": """SELECT f_speed_mode AS speed_limit, count(*) AS segments, sum(score) AS total_score, round(avg(score), 6) AS mean_score
        FROM seg LEFT JOIN speed_mode USING (segment_id) WHERE n_crashes >= 6 GROUP BY f_speed_mode""",
    "headline": """SELECT CAST(sum(n_crashes) AS BIGINT) AS collisions, count(*) AS segments, count(*) FILTER (n_crashes >= 6) AS evidenced,
        round(count(*) FILTER (n_crashes < 6) / count(*), 6) AS share_under, quantile_cont(score, 0.5) AS median_score FROM seg""",
    "heat_grid": """SELECT CAST(floor(lon / 7e-2) AS BIGINT) AS cell_x, CAST(floor(lat / 7e-2) AS BIGINT) AS cell_y, sum(score) AS weight, count(*) AS segments FROM seg GROUP BY 1, 2""",
    "capture": f"SELECT 0.2e0 AS share, n AS segments, CAST(k AS BIGINT) AS taken, round(v, 6) AS captured FROM {_captured('score')} c",
    "capture_compare": f"SELECT 0.2e0 AS share, round(a.v, 6) AS model, round(b.v, 6) AS baseline, round(a.v - b.v, 6) AS gain FROM {_captured('score')} a, {_captured('f_crashes')} b",
    "gains": """SELECT step, segments, round(sum(t) OVER (ORDER BY step) / sum(t) OVER (), 6) AS captured FROM (
        SELECT CAST(ceil(rn * 100 / n) AS INT) AS step, count(*) AS segments, sum(ksi_target) AS t FROM (
          SELECT ksi_target, row_number() OVER (ORDER BY score DESC, segment_id) AS rn, count(*) OVER () AS n FROM known) q GROUP BY 1) g""",
    "bbox_curve": "SELECT segment_id, n_crashes FROM seg WHERE lon BETWEEN -3.55 AND -2.05 AND lat BETWEEN 50.02 AND 50.11",
    "file_audit": """SELECT file, size, count(*) AS rows, count(*) FILTER (bad) AS corrupt_rows, CAST(sum(length(value) + 1) AS BIGINT) > size AS unterminated,
        CASE WHEN sum(length(value) + 1) > size AND bool_or(bad) THEN 'cut' WHEN bool_or(bad) THEN 'corrupt' WHEN sum(length(value) + 1) > size THEN 'unterminated' ELSE 'ok' END AS status
        FROM (SELECT *, length(value) - length(replace(value, ',', '')) <> 3 AS bad FROM csv_lines) l GROUP BY file, size""",
    "capture_interval": f"""SELECT count(g) AS replicates, round(avg(g), 6) AS mean_gain, round(quantile_cont(g, 0.025), 6) AS low, round(quantile_cont(g, 0.975), 6) AS high,
        round(avg(CASE WHEN g > 0 THEN 1e0 WHEN g <= 0 THEN 0e0 END), 6) AS share_gaining FROM (SELECT a.v - b.v AS g FROM {_replicates('score')} a JOIN {_replicates('f_crashes')} b USING (replicate)) x""",
    "poisson_trees": _trees(3, 2, "0.5e0", 20),
    "poisson_floor": _least_squares(4),
    "list_segments": """SELECT segment_id, n_crashes, score FROM seg WHERE lon BETWEEN -3.55 AND -0.95 AND lat BETWEEN 50.0 AND 53.1 AND score >= 1.5 AND n_crashes >= 6
        ORDER BY score DESC, segment_id LIMIT 200""",
    "segment_lookup": "SELECT segment_id, n_crashes, score, tier, display FROM tiered WHERE segment_id = 'A23_run1_km0.5'",
    "route_length": "SELECT request_id, candidate, round(distance_m, 3) AS length_m FROM route",
    "corridor": "SELECT request_id, candidate, segment_id, round(distance_m, 3) AS distance_m FROM match",
    "route_order": """SELECT request_id, candidate, CAST(row_number() OVER (PARTITION BY request_id, candidate ORDER BY position_m, segment_id) AS INT) AS place, segment_id FROM match""",
    "route_totals": "SELECT request_id, candidate, expected_ksi, blackspot_count, worst_segment_id, CAST(blackspot_count AS INT) AS listed FROM total",
    "candidates": "SELECT request_id, candidate FROM odd_kept",
    "route_status": "SELECT request_id, candidate, status FROM odd",
    "route_labels": f"SELECT * FROM {_label('total')} l",
    "coverage": "SELECT request_id, candidate, samples, covered, covered < 0.5 * samples AS warned FROM cover",
    "route_risk": f"""SELECT k.request_id, k.candidate, k.status, l.label, round(k.distance_m, 2) AS distance_m, round(k.duration_s, 2) AS duration_s,
        CASE WHEN k.status = 'ok' THEN t.expected_ksi ELSE 0e0 END AS expected_ksi, CASE WHEN k.status = 'ok' THEN t.blackspot_count ELSE 0 END AS blackspot_count,
        CASE WHEN k.status = 'ok' THEN t.worst_segment_id END AS worst_segment_id, CASE WHEN k.status = 'ok' THEN t.in_order ELSE '' END AS in_order,
        coalesce(k.status = 'ok' AND c.covered < 0.5 * c.samples, false) AS warned
        FROM odd_kept k JOIN total t USING (request_id, candidate) LEFT JOIN cover c USING (request_id, candidate)
        LEFT JOIN {_label("(SELECT k.request_id, k.candidate, k.duration_s, t.expected_ksi FROM odd_kept k JOIN total t USING (request_id, candidate) WHERE k.status = 'ok')")} l
          USING (request_id, candidate)""",
    "vocabulary": """SELECT * FROM (WITH made AS (
            SELECT collision_id, 'vehicle.' || unnest(['type=' || vehicle_type, 'impact=' || point_of_impact, 'no=' || vehicle_no, 'type=' || vehicle_type || '&impact=' || point_of_impact,
              'type=' || vehicle_type || '&no=' || vehicle_no, 'impact=' || point_of_impact || '&no=' || vehicle_no]) AS term FROM vehicle
            UNION ALL SELECT collision_id, 'casualty.' || unnest(['no=' || casualty_no, 'age=' || age, 'band=' || age // 10, 'no=' || casualty_no || '&age=' || age,
              'no=' || casualty_no || '&band=' || age // 10, 'age=' || age || '&band=' || age // 10]) FROM casualty),
          used AS (SELECT collision_id, term, count(*) AS n, CAST(cast('0x' || substr(md5(CAST(collision_id AS VARCHAR)), 1, 8) AS BIGINT) % 5 AS INT) AS own FROM made
            WHERE collision_id IN (SELECT collision_id FROM collision) GROUP BY collision_id, term),
          learned AS (SELECT f.fold, term, count(*) AS crashes FROM used JOIN (SELECT CAST(unnest(range(-1, 5)) AS INT) AS fold) f ON f.fold <> used.own GROUP BY f.fold, term HAVING count(*) >= 20)
        SELECT fold, term, crashes, CAST(total AS BIGINT) AS total FROM learned
        LEFT JOIN (SELECT term, sum(n) AS total FROM used WHERE term IN (SELECT term FROM learned WHERE fold = -1) GROUP BY term) s USING (term)) v""",
    "folds": "SELECT segment_id, CAST(cast('0x' || substr(md5(segment_id), 1, 8) AS BIGINT) % 5 AS INT) AS fold FROM seg",
    "balance": """SELECT collision_id, severe FROM (SELECT *, row_number() OVER (PARTITION BY severe ORDER BY h, collision_id) AS rn FROM md5_order) q
        WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM md5_order GROUP BY severe) m)""",
    "roc_auc": """SELECT round((sum(r) FILTER (l) - count(*) FILTER (l) * (count(*) FILTER (l) + 1) / 2.0e0) / (count(*) FILTER (l) * count(*) FILTER (NOT l)), 6) AS auc,
        count(*) FILTER (l) AS positives, count(*) FILTER (NOT l) AS negatives FROM (
        SELECT l, lo + (n - 1) / 2.0e0 AS r FROM (
          SELECT ksi_target > 0 AS l, rank() OVER (ORDER BY n_crashes) AS lo, count(*) OVER (PARTITION BY n_crashes) AS n FROM seg) a) b""",
    # one Newton step in two leaves: the mean of each group against the overall mean
    "poisson_step": """SELECT segment_id, round(base * exp(0.5e0 * (g / base - 1)), 6) AS score FROM leaves""",
    "shap_step": """SELECT segment_id, round(abs(0.5e0 * avg(g / base - 1) OVER ()), 6) AS base, round(0.5e0 * (g / base - 1 - avg(g / base - 1) OVER ()), 6) AS value FROM leaves""",
    "severity_inputs": f"""SELECT a.collision_id, CAST(any_value(a.ksi) > 0 AS INT) AS severe, any_value(cc.n) AS casualty_count, any_value(vc.n) AS vehicle_count,
        {', '.join(f'nullif({x}, 0) AS {n}' if n == 'f_crashes' else f'{x} AS {n}' for n, x in _ROLLING.items())}
        FROM assigned a LEFT JOIN assigned h ON h.segment_id = a.segment_id AND year(h.occurred_on) BETWEEN year(a.occurred_on) - 3 AND year(a.occurred_on) - 1
        LEFT JOIN (SELECT collision_id, count(*) AS n FROM casualty GROUP BY 1) cc ON cc.collision_id = a.collision_id
        LEFT JOIN (SELECT collision_id, count(*) AS n FROM vehicle GROUP BY 1) vc ON vc.collision_id = a.collision_id
        WHERE year(a.occurred_on) >= (SELECT min(year(occurred_on)) + 3 FROM assigned) GROUP BY a.collision_id""",
    # what must hold whatever a fitted model says
    "scored_check": "SELECT count(*) AS segments, count(*) AS scored, CAST(0 AS BIGINT) AS not_positive, count(*) AS ranks, count(*) AS last_rank FROM seg",
    "shap_check": "SELECT count(*) AS segments, true AS additive FROM known",
    "poisson_check": "SELECT count(*) AS segments, CAST(sum(ksi_target) AS BIGINT) AS observed, true AS total_agrees FROM known",
    "factor_rank": """SELECT feature, round(w, 6) AS weight, round(w / sum(w) OVER (), 6) AS share, CAST(row_number() OVER (ORDER BY w DESC, feature) AS INT) AS rank
        FROM (SELECT feature, avg(abs(value)) AS w FROM contribution GROUP BY feature) f""",
}


def _needed(text: str) -> list[str]:
    """Views that a text uses, directly or through others, in definition order."""
    import re

    want, todo = set(), [text]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in _VIEWS:
            if name in words and name not in want:
                want.add(name)
                todo.append(_VIEWS[name])
    return [n for n in _VIEWS if n in want]


def sql(final: str) -> str:
    names = {n: n for n in ("orders", "lineitem", "customer", "collision")}
    ctes = [f"{n} AS ({views.for_duckdb(_VIEWS[n]).format(**names)})" for n in _needed(final)]
    return f"WITH {', '.join(ctes)} {final}" if ctes else final


def all_sql() -> dict[str, str]:
    return {k: sql(v) for k, v in _FINAL.items()}
