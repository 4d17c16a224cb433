"""The registered queries as DuckDB SQL, written independently: one CTE for each rounded step."""

from __future__ import annotations

import math

from panelwright.operators.regression import BINS, RATE, ROUNDS
from panelwright.operators.rules import COLOURS, LABEL_FINDINGS, NO_ACTION, SUMMARIES, UNKNOWN_ACTION
from panelwright.operators.weather import LIFETIME_S
from panelwright.plans.pipeline import GENERIC
from panelwright.plans.queries import THUMBNAILS
from panelwright.settings import FEATURE_RANGES, IMAGE_MEAN, IMAGE_STD, LABELS, MODEL_COLUMNS, MOUNT_TYPES, SOILING, WEATHER_DEFAULTS
from panelwright.sources.adapters import PNG_KINDS, SIDES
from panelwright.sources.images import BAD_IMAGE, EMPTY_IMAGE, NO_IMAGE


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def num(x: float) -> str:
    """A DOUBLE literal; a plain decimal would be exact, and other arithmetic."""
    return f"{float(x)!r}::DOUBLE"


def rounded(x: str, places: int) -> str:
    """The exact value rounded, ties to even."""
    s, d = f"{10**places}e0", f"{2 * 10**places}e0"
    k = f"floor({x}*{s})"
    mid = f"((2e0*{k}+1e0)/{d})"
    hi = f"(134217729e0*{x}-(134217729e0*{x}-{x}))"
    above = f"(({hi}*{d}-(2e0*{k}+1e0))+({x}-{hi})*{d})"
    return (
        f"CASE WHEN {x} IS NULL OR isnan({x}) OR isinf({x}) THEN {x} WHEN {x} < {mid} THEN {k}/{s} WHEN {x} > {mid} THEN ({k}+1e0)/{s} "
        f"WHEN {above} < 0 THEN {k}/{s} WHEN {above} > 0 THEN ({k}+1e0)/{s} WHEN {k}::BIGINT % 2 = 0 THEN {k}/{s} ELSE ({k}+1e0)/{s} END"
    )


def clamped(x: str, low: float, high: float) -> str:
    return f"CASE WHEN {x} < {num(low)} THEN {num(low)} WHEN {x} > {num(high)} AND NOT isnan({x}) THEN {num(high)} ELSE {x} END"


def listed_numbers(values) -> str:
    return "[" + ", ".join(map(str, values)) + "]"


class With:
    """Builds a chain of CTEs; ``step`` adds a rounded column, ``add`` plain ones."""

    def __init__(self, name: str, sql: str):
        self.parts = [f"{name} AS ({sql})"]
        self.last = name

    def add(self, **columns: str) -> With:
        made = ", ".join(f"{sql} AS {name}" for name, sql in columns.items())
        return self._next(f"SELECT *, {made} FROM {self.last}")

    def swap(self, **columns: str) -> With:
        """Columns with new values."""
        made = ", ".join(f"{sql} AS {name}" for name, sql in columns.items())
        return self._next(f"SELECT * REPLACE ({made}) FROM {self.last}")

    def step(self, name: str, sql: str, places: int) -> With:
        self.add(x_=sql)
        return self._next(f"SELECT * EXCLUDE (x_), {rounded('x_', places)} AS {name} FROM {self.last}")

    def _next(self, sql: str) -> With:
        name = f"t{len(self.parts)}"
        self.parts.append(f"{name} AS MATERIALIZED ({sql})")
        self.last = name
        return self

    def sql(self, tail: str) -> str:
        return f"WITH {', '.join(self.parts)} " + tail.replace("@", self.last)


def listed(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


OBSERVED = f"""SELECT e.event_id AS run_id, e.ts AS observation_time, n.n_name AS city,
 ((n.n_nationkey*7) % 181 - 90)::DOUBLE AS latitude, ((n.n_nationkey*29) % 361 - 180)::DOUBLE AS longitude,
 e.value - 50e0 AS cloud_cover_pct, (e.event_id % 2001)::DOUBLE/100e0 AS wind_speed_ms,
 ((e.event_id*37) % 600)::DOUBLE/10e0 - 10e0 AS ambient_temp_c,
 CAST(json_extract_string(e.props, '$.k') AS DOUBLE) AS humidity_pct,
 list_extract({listed((*LABELS, "Unknown", "dusty"))}, (e.event_id % 8)::INT + 1) AS label,
 (e.event_id % 101)::DOUBLE/100e0 AS detection_confidence
 FROM events e JOIN nation n ON n.n_nationkey = e.event_id % 25"""

SOILED = "CASE label " + " ".join(f"WHEN {q(k)} THEN {num(v)}" for k, v in SOILING.items()) + " ELSE 1e0 END"
CLASS = "CASE label " + " ".join(f"WHEN {q(k)} THEN {i}e0" for i, k in enumerate(LABELS)) + " ELSE 0e0 END"


def observed() -> With:
    return With("obs", OBSERVED)


def with_physics(w: With) -> With:
    w.step("cloud_factor", f"1e0 - ({clamped('cloud_cover_pct', 0, 100)})/100e0", 4)
    w.step("wind_cooling_factor", "1.5e0*wind_speed_ms", 2)
    w.add(raw_="hour(observation_time) + minute(observation_time)/60e0 + longitude/15e0")
    w.add(solar_="CASE WHEN raw_ % 24e0 < 0 THEN (raw_ % 24e0 + 24e0) % 24e0 ELSE raw_ % 24e0 END")
    w.add(
        sine_=f"sin({num(math.pi)}*(solar_-6e0)/12e0)", cosine_="cos(radians(latitude))",
    )
    w.step(
        "irradiance_wm2",
        f"1000e0*((CASE WHEN sine_ > 0 THEN sine_ ELSE 0e0 END)*(CASE WHEN cosine_ > 0.1e0 THEN cosine_ ELSE 0.1e0 END))*({clamped('cloud_factor', 0, 1)})",
        2,
    )
    w.step("module_temp_c", "ambient_temp_c + 25e0/800e0*irradiance_wm2 - wind_cooling_factor", 2)
    w.add(soiling_ratio=SOILED)
    w.add(change_="-(-0.004e0*(module_temp_c-25e0)*100e0)")
    w.step("temp_loss_pct", "CASE WHEN change_ > 0 THEN change_ ELSE 0e0 END", 2)
    return w.step("effective_efficiency", "soiling_ratio*(1e0-temp_loss_pct/100e0)", 4)


def with_features(w: With) -> With:
    return with_physics(w).add(fault_class_id=CLASS, temperature_difference_c="module_temp_c - ambient_temp_c")


def with_loss(w: With, raw: str = "100e0*(1e0-effective_efficiency)") -> With:
    w.add(raw_loss=raw)
    w.add(prediction_successful="raw_loss IS NOT NULL AND NOT isnan(raw_loss) AND NOT isinf(raw_loss)")
    w.add(efficiency_loss_pct=f"CASE WHEN prediction_successful THEN {clamped('raw_loss', 0, 100)} ELSE 0e0 END")
    return w.add(estimated_output_w="CASE WHEN prediction_successful THEN 400e0*(1e0-efficiency_loss_pct/100e0) ELSE 0e0 END")


def predicted() -> With:
    return with_loss(with_features(observed()))


FAULTY = {
    "humidity_pct": "CASE WHEN run_id % 41 = 0 THEN 'NaN'::DOUBLE ELSE humidity_pct + CASE WHEN run_id % 43 = 0 THEN 200e0 ELSE 0e0 END END",
    "detection_confidence": "CASE WHEN run_id % 47 = 0 THEN NULL WHEN run_id % 53 = 0 THEN 'Infinity'::DOUBLE ELSE detection_confidence END",
    "module_temp_c": "CASE WHEN run_id % 7 = 0 THEN ambient_temp_c + 15 + (run_id % 3 - 1) ELSE module_temp_c END",
}
RAW = (*MODEL_COLUMNS, "temperature_difference_c", "cloud_factor", "wind_cooling_factor")


def missing(c: str) -> str:
    return f"({c} IS NULL OR isnan({c}))"


NAN_LIST = "list_filter([" + ", ".join(f"CASE WHEN {missing(c)} THEN '{c}' END" for c in RAW) + "], lambda v: v IS NOT NULL)"
RANGE_LIST = (
    "list_filter(["
    + ", ".join(f"CASE WHEN NOT coalesce({c} BETWEEN {lo} AND {hi}, false) THEN '{c}' END" for c, (lo, hi) in FEATURE_RANGES.items())
    + "], lambda v: v IS NOT NULL)"
)
CONSISTENCY = "Numeric Consistency: Module temp anomalously high given near-zero irradiance."
ODD = "(irradiance_wm2 < 10 AND NOT isnan(module_temp_c) AND module_temp_c > ambient_temp_c + 15)"


def faulty() -> With:
    w = with_features(observed()).swap(**FAULTY)
    w.add(x_="cloud_cover_pct")
    w._next(f"SELECT * EXCLUDE (x_) REPLACE ({rounded('x_', 2)} AS cloud_cover_pct) FROM {w.last}")
    return w


def validated(w: With) -> With:
    w.add(nan_columns=NAN_LIST, ranges_=RANGE_LIST)
    w.add(n_violations=f"CASE WHEN len(nan_columns) = 0 THEN len(ranges_) + CASE WHEN {ODD} THEN 1 ELSE 0 END ELSE 0 END")
    return w.add(feature_status="CASE WHEN len(nan_columns) > 0 THEN 'NAN' WHEN n_violations > 0 THEN 'RANGE' ELSE 'VALID' END")


def with_rules(w: With) -> str:
    """CTEs up to ``found``: a row per finding, with rank and rule."""
    branches = "CASE label " + " ".join(f"WHEN {q(k)} THEN %s" for k in LABEL_FINDINGS) + " ELSE %s END"
    pick = lambda i, other: branches % (*[q(v[i]) for v in LABEL_FINDINGS.values()], other)
    unknown = "'Fault class ''' || coalesce(label, 'None') || ''' detected. Manual inspection recommended.'"
    t = w.last
    loss = "not isnan(efficiency_loss_pct) AND efficiency_loss_pct >="
    found = f"""found AS (
 SELECT *, 0 AS rule, {pick(0, q("INFO"))} AS severity, {pick(1, unknown)} AS message, {pick(2, q(UNKNOWN_ACTION))} AS action FROM {t}
 UNION ALL SELECT *, 1, 'CRITICAL', 'Predicted efficiency loss of ' || printf('%.1f', efficiency_loss_pct) || '% exceeds the critical threshold (20%). Immediate intervention required.', 'Schedule emergency maintenance' FROM {t} WHERE {loss} 20
 UNION ALL SELECT *, 1, 'WARNING', 'Predicted efficiency loss of ' || printf('%.1f', efficiency_loss_pct) || '% is above the advisory threshold (10%). Plan maintenance soon.', 'Schedule maintenance within 7 days' FROM {t} WHERE {loss} 10 AND efficiency_loss_pct < 20
 UNION ALL SELECT *, 2, 'WARNING', 'Module temperature (' || printf('%.1f', module_temp_c) || '°C) exceeds safe operating limit (65°C).', 'Check for shading, soiling, or ventilation obstructions' FROM {t} WHERE NOT isnan(module_temp_c) AND module_temp_c >= 65
 UNION ALL SELECT *, 3, 'INFO', 'Irradiance is very low (' || printf('%.0f', irradiance_wm2) || ' W/m²). Predictions are less reliable under night/heavy overcast conditions.', 'Re-run analysis during daylight hours' FROM {t} WHERE irradiance_wm2 < 50)"""
    w.parts.append(found)
    w.last = "found"
    w.add(rank_="CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'WARNING' THEN 2 WHEN 'INFO' THEN 1 ELSE 0 END")
    return w._next(f"SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY rank_ DESC, rule) - 1 AS position FROM {w.last}").last


def ruled() -> With:
    w = predicted()
    with_rules(w)
    return w


SUMMARY = "CASE overall_severity " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in SUMMARIES.items()) + " END"


def reports() -> With:
    w = ruled()
    w._next(
        f"SELECT run_id, any_value(city) AS city, any_value(estimated_output_w) AS estimated_output_w, arg_min(severity, position) AS overall_severity, "
        f"arg_min(action, position) AS recommendation, count(*) AS n_issues FROM {w.last} GROUP BY run_id"
    )
    return w.add(summary=SUMMARY, priority="overall_severity")


def report_texts() -> str:
    w = ruled()
    issue = "{'severity': severity, 'message': message, 'action': action}"
    w._next(
        f"SELECT run_id, arg_min(severity, position) AS overall_severity, arg_min(action, position) AS recommendation, "
        f"list({issue} ORDER BY position) AS issues FROM {w.last} GROUP BY run_id"
    )
    report = "{'status': overall_severity, 'summary': summary, 'issues': issues, 'recommendation': recommendation, 'priority': overall_severity}"
    return w.add(summary=SUMMARY).sql(f"SELECT run_id, to_json({report})::VARCHAR AS report FROM @")


def feature_message() -> str:
    outside = [
        f"CASE WHEN list_contains(ranges_, '{c}') THEN '  ''{c}'': ' || printf('%.4g', {c}) || ' is outside [{lo}, {hi}]' END" for c, (lo, hi) in FEATURE_RANGES.items()
    ]
    told = f"list_filter([{', '.join(outside)}, CASE WHEN {ODD} THEN {q('  ' + CONSISTENCY)} END], lambda v: v IS NOT NULL)"
    names = "'[' || array_to_string(list_transform(nan_columns, lambda v: chr(39) || v || chr(39)), ', ') || ']'"
    return (
        f"CASE feature_status WHEN 'NAN' THEN 'DataFrame contains NaN values in columns: ' || {names} "
        f"ELSE 'One or more feature values failed validation:' || chr(10) || array_to_string({told}, chr(10)) END"
    )


SCALARS = """SELECT event_id AS run_id, (event_id % 131)::DOUBLE - 5e0 AS panel_age, event_id % 61 - 2 AS maintenance_count,
 CASE WHEN event_id % 97 = 0 THEN 'NaN'::DOUBLE ELSE (event_id % 1203)::DOUBLE - 3e0 END AS voltage,
 CASE WHEN event_id % 89 = 0 THEN 'Infinity'::DOUBLE ELSE (event_id % 127)::DOUBLE - 1e0 END AS current_,
 list_extract(['rooftop', 'ground-mount', 'carport', 'floating', '', '  ', 'wall'], (event_id % 7)::INT + 1) AS installation_type FROM events"""
INPUT_ERROR = """CASE WHEN isnan(panel_age) OR isinf(panel_age) THEN '''panel_age'' must be a finite number.'
 WHEN NOT panel_age BETWEEN 0 AND 100 THEN '''panel_age'' must be between 0 and 100 years, got ' || printf('%g', panel_age) || '.'
 WHEN maintenance_count < 0 THEN '''maintenance_count'' must be >= 0, got ' || maintenance_count || '.'
 WHEN isnan(voltage) OR isinf(voltage) THEN '''voltage'' must be a finite number.' WHEN voltage < 0 THEN '''voltage'' must be >= 0 V, got ' || printf('%g', voltage) || '.'
 WHEN isnan(current_) OR isinf(current_) THEN '''current'' must be a finite number.' WHEN current_ < 0 THEN '''current'' must be >= 0 A, got ' || printf('%g', current_) || '.'
 WHEN trim(installation_type) = '' THEN '''installation_type'' must be a non-empty string (e.g. ''rooftop'' or ''ground-mount'').' END"""

TEXTS = """SELECT event_id AS run_id, CASE event_id % 9
 WHEN 0 THEN '  City' || chr(9) || event_id || chr(10) WHEN 1 THEN chr(12288) || 'São Paulo ' || event_id || chr(12288) WHEN 2 THEN '   '
 WHEN 3 THEN repeat('A' || event_id, 60) WHEN 4 THEN '' WHEN 5 THEN 'a' || chr(127) || 'b' || event_id WHEN 6 THEN NULL
 WHEN 7 THEN '../../' || event_id || '; rm   -rf /' ELSE 'Chennai ' || event_id END AS raw FROM events"""
CONTROL = "'[\\x00-\\x1f\\x7f]'"
SPACE = "[\\s\\x{3000}\\x{a0}\\x{85}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}]"
STRIPPED = f"regexp_replace(%s, '^{SPACE}+|{SPACE}+$', '', 'g')"


def city_of(x: str) -> str:
    s = STRIPPED % x
    return f"CASE WHEN {x} IS NULL OR regexp_matches({x}, {CONTROL}) OR {s} = '' THEN NULL ELSE left({s}, 100) END"


PAYLOADS = """SELECT event_id AS run_id, event_id % 12 AS k, event_id AS e,
 CASE event_id % 12 WHEN 7 THEN '' WHEN 8 THEN 'a' || chr(9) || 'b' ELSE ' City ' || event_id % 30 || ' ' END AS city,
 ((event_id*37) % 600)::DOUBLE/10e0 - 10e0 AS temp FROM events"""


def weather() -> With:
    """The payload's fields straight from the numbers it was made of, k telling what is wrong with it."""
    w = With("p", PAYLOADS).add(clean=city_of("city"))
    w.add(ok="clean IS NOT NULL AND k NOT IN (1, 2, 5, 6, 9, 10)", crashed="clean IS NOT NULL AND k IN (6, 10)")
    return w.add(name_="CASE WHEN k = 4 THEN clean ELSE 'Station ' || e % 50 END")


def defaulted(c: str, value: str) -> str:
    return f"CASE WHEN ok THEN ({value})::DOUBLE ELSE {num(WEATHER_DEFAULTS[c])} END AS {c}"


BOXES = "SELECT l_orderkey AS run_id, l_linenumber AS ord, l_quantity, l_extendedprice, l_discount AS confidence, (l_suppkey % 3)::INT AS class_id FROM lineitem"
LOGITS = "SELECT vec_id AS run_id, list_transform(embedding[1:%d], lambda v: v::DOUBLE) AS logits FROM embeddings"
SOFT = With("l", LOGITS % 6).add(e_="list_transform(logits, lambda v: exp(v - list_max(logits)))").add(s_="list_sum(e_)")
PROBS = (
    SOFT._next("SELECT run_id, unnest(e_) / s_ AS p0, unnest(range(6))::INT AS class_id FROM " + SOFT.last)
    ._next(f"SELECT run_id, class_id, {rounded('p0', 6)} AS p FROM {SOFT.last}")
)


def physics_query(*columns: str) -> str:
    return with_physics(observed()).sql(f"SELECT run_id, {', '.join(columns)} FROM @")


def rule(n: int) -> str:
    return ruled().sql(f"SELECT run_id, severity, message, action FROM @ WHERE rule = {n}")


def runs() -> With:
    w = predicted()
    obs = w.last
    w.parts.append(f"inputs AS ({SCALARS})")
    w.parts.append(f"checked AS (SELECT o.* REPLACE (CASE WHEN run_id % 71 = 0 THEN 'Chennai' ELSE city END AS city), {INPUT_ERROR} AS input_error FROM {obs} o JOIN inputs USING (run_id))")
    w.last = "checked"
    validated(w)
    w.add(
        error_stage="""CASE WHEN run_id % 83 = 0 THEN 'image' WHEN input_error IS NOT NULL THEN 'inputs' WHEN run_id % 59 = 0 THEN 'detect'
 WHEN run_id % 61 = 0 THEN 'classify' WHEN run_id % 67 = 0 THEN 'weather' WHEN feature_status <> 'VALID' THEN 'features'
 WHEN NOT prediction_successful THEN 'predict' ELSE 'none' END"""
    )
    base = w.last
    with_rules(w)
    w._next(f"SELECT run_id, arg_min(severity, position) AS sev_, arg_min(action, position) AS act_ FROM {w.last} GROUP BY run_id")
    w._next(f"SELECT b.*, sev_, act_ FROM {base} b JOIN {w.last} USING (run_id)")
    return w


EARLY = "error_stage IN ('image', 'inputs', 'detect', 'classify'%s)"
ENTRIES = """SELECT s_suppkey AS ord, s_suppkey % 11 AS k, 'm/' || s_suppkey || '.bin' AS name, sha256(s_name) AS digest FROM supplier"""
ENTRY = With("s", ENTRIES).add(
    path="CASE k WHEN 0 THEN '/' || name WHEN 1 THEN 'm/../../' || name WHEN 2 THEN '' ELSE name END",
    sha="CASE k WHEN 3 THEN 'xyz' WHEN 4 THEN upper(digest) WHEN 5 THEN sha256('other') ELSE digest END",
    there="k <> 6 AND k > 2",
)


def geometry(columns: str) -> str:
    return f"WITH g AS (SELECT event_id AS run_id, (event_id*31 % 1999 + 1)::DOUBLE AS w, (event_id*17 % 1499 + 1)::DOUBLE AS h FROM events) {columns}"


RAW_OUTPUTS = """SELECT event_id AS run_id, CASE WHEN event_id % 17 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 19 = 0 THEN 'Infinity'::DOUBLE
 WHEN event_id % 23 = 0 THEN NULL ELSE (event_id % 141)::DOUBLE - 20e0 END AS raw FROM events"""


def _channels() -> str:
    w = With("v", "SELECT event_id AS run_id, (event_id % 256)::DOUBLE AS a, (event_id*3 % 256)::DOUBLE AS b, (event_id*7 % 256)::DOUBLE AS c FROM events")
    for i, (column, m, s) in enumerate(zip("abc", IMAGE_MEAN, IMAGE_STD)):
        w.step(f"channel_{i}", f"({column}/255e0 - {num(m)})/{num(s)}", 6)
    return w.sql("SELECT run_id, channel_0, channel_1, channel_2 FROM @")


def _as_of() -> str:
    w = observed().swap(observation_time="CASE WHEN run_id % 5 <> 0 THEN observation_time ELSE TIMESTAMP '2024-06-01 10:30:00' END")
    return with_physics(w).sql("SELECT run_id, irradiance_wm2, hour(observation_time)::INT AS hour FROM @")


#: Weights of the old places for each new one along a side, in 22 bits.
TAPS = """
SELECT size, out, o, i, floor(0.5e0 + wt * (1e0 / sum(wt) OVER (PARTITION BY size, out, o)) * 4194304e0)::BIGINT AS k FROM (
  SELECT *, greatest(0e0, 1e0 - abs((i - centre + 0.5e0) * (1e0 / wide))) AS wt FROM (
    SELECT *, unnest(range(greatest(trunc(centre - wide + 0.5e0)::BIGINT, 0), least(trunc(centre + wide + 0.5e0)::BIGINT, size))) AS i FROM (
      SELECT size, out, o, (o + 0.5e0) * (size::DOUBLE / out) AS centre, greatest(size::DOUBLE / out, 1e0) AS wide
      FROM (SELECT DISTINCT {size} AS size, {out} AS out, unnest(range({out})) AS o FROM g))))
"""

#: Images, and the bytes of good ones: pixel p, channel c.
PIXELS = f"""WITH s AS (
  SELECT vec_id AS run_id, vec_id AS k, list_transform(embedding, lambda x: floor(abs(x::DOUBLE) * 1000)::BIGINT) AS e,
    {listed_numbers(SIDES[0])}[vec_id % 6 + 1] AS w, {listed_numbers(SIDES[1])}[(vec_id // 6) % 6 + 1] AS h,
    {listed_numbers(n for _, n in PNG_KINDS)}[vec_id % 5 + 1] AS n FROM embeddings
),
px AS MATERIALIZED (
  SELECT run_id, p, c, CASE WHEN n = 1 AND k % 5 = 2 THEN CASE c WHEN 0 THEN v WHEN 1 THEN 255 - v ELSE v * 7 % 256 END ELSE v END AS v
  FROM (
    SELECT run_id, k, n, p, c, (e[i % 64 + 1] + i * 7 + k) % 256 AS v
    FROM (SELECT *, p * n + CASE WHEN n < 3 THEN 0 ELSE c END AS i FROM (SELECT *, unnest(range(w * h)) AS p FROM s) CROSS JOIN range(3) AS t(c))
    WHERE k % 11 > 4
  )
)"""
IMAGE_ERRORS = f""", f AS (
  SELECT *, CASE run_id % 11 WHEN 0 THEN {q(NO_IMAGE)} WHEN 1 THEN {q(EMPTY_IMAGE)} WHEN 2 THEN {q("image file is truncated".join(BAD_IMAGE))}
    WHEN 3 THEN {q("broken chunk".join(BAD_IMAGE))} WHEN 4 THEN {q("cannot identify image file".join(BAD_IMAGE))} ELSE '' END AS why FROM s
)"""

def boosted(tail: str, rounds: int = ROUNDS, bins: int = BINS, rate: float = RATE) -> str:
    """CTEs x (rows), c (edges), b (bins) and, for each round, the split and what it leaves."""
    w = with_features(observed()).add(y_="floor((100e0*(1e0-effective_efficiency) + ((run_id * 7919 % 1000) / 500e0 - 1e0)) * 1000000e0 + 0.5e0)::BIGINT")
    w.parts += [
        f"x AS MATERIALIZED (SELECT run_id, y_ AS y, unnest([{', '.join(MODEL_COLUMNS)}]) AS x, unnest(range({len(MODEL_COLUMNS)}))::INT AS f FROM {w.last})",
        "ends AS (SELECT f, min(x) FILTER (isfinite(x)) AS lo, max(x) FILTER (isfinite(x)) AS hi FROM x GROUP BY f)",
        f"c AS MATERIALIZED (SELECT f, k, lo + (hi - lo) * k / {bins}e0 AS edge FROM ends, range(1, {bins}) AS t(k))",
        "b AS MATERIALIZED (SELECT x.run_id, x.f, count(*) FILTER (x.x >= c.edge) AS bin FROM x LEFT JOIN c USING (f) GROUP BY ALL)",
        "base AS MATERIALIZED (SELECT floor(sum(y) / count(*)::DOUBLE + 0.5e0)::BIGINT AS base FROM x WHERE f = 0)",
        "r0 AS MATERIALIZED (SELECT run_id, y - base AS r FROM x, base WHERE f = 0)",
    ]
    for i in range(rounds):
        w.parts += [
            f"h{i} AS MATERIALIZED (SELECT f, bin, count(*) AS n, sum(r)::BIGINT AS s FROM b JOIN r{i} USING (run_id) GROUP BY ALL)",
            f"""s{i} AS MATERIALIZED (
  SELECT f, k, floor({num(rate)} * (sl / nl::DOUBLE) + 0.5e0)::BIGINT AS below, floor({num(rate)} * (sr / nr::DOUBLE) + 0.5e0)::BIGINT AS above FROM (
    SELECT f, k, sum(n) FILTER (bin < k) AS nl, sum(s) FILTER (bin < k) AS sl, sum(n) FILTER (bin >= k) AS nr, sum(s) FILTER (bin >= k) AS sr
    FROM h{i}, range(1, {bins}) AS t(k) GROUP BY f, k)
  WHERE nl > 0 AND nr > 0 ORDER BY sl::DOUBLE * sl::DOUBLE / nl::DOUBLE + sr::DOUBLE * sr::DOUBLE / nr::DOUBLE DESC, f, k LIMIT 1
)""",
            f"r{i + 1} AS MATERIALIZED (SELECT b.run_id, r - CASE WHEN bin >= k THEN above ELSE below END AS r FROM s{i} JOIN b USING (f) JOIN r{i} USING (run_id))",
        ]
    return w.sql(tail)


def _stumps(rounds: int = ROUNDS) -> str:
    rows = [f"SELECT {i + 1} AS round, {listed(MODEL_COLUMNS)}[f + 1] AS feature, edge, below, above FROM s{i} JOIN c USING (f, k)" for i in range(rounds)]
    return " UNION ALL ".join(["SELECT 0 AS round, '' AS feature, NULL::DOUBLE AS edge, base AS below, base AS above FROM base", *rows])


_LOG_FIELDS = {c: 41 + 2 * i for i, c in enumerate(("ambient_temp_c", "humidity_pct", "wind_speed_ms", "cloud_cover_pct", "pressure_hpa", "latitude", "longitude"))}
AS_OF = f"""WITH e AS (SELECT * FROM events JOIN nation ON n_nationkey = event_id % 25),
r AS (SELECT event_id AS run_id, CASE WHEN event_id % 97 <> 0 THEN n_name END AS city, ts FROM e),
w AS (SELECT n_name AS city, ts AS seen, {", ".join(f"(event_id % {m})::DOUBLE AS {c}" for c, m in _LOG_FIELDS.items())} FROM e WHERE event_type = 'view')
SELECT run_id, r.city, {", ".join(f"CASE WHEN seen >= ts - INTERVAL {LIFETIME_S} SECONDS THEN {c} ELSE {num(WEATHER_DEFAULTS[c])} END AS {c}" for c in _LOG_FIELDS)},
  coalesce(seen >= ts - INTERVAL {LIFETIME_S} SECONDS, false) AS fetch_successful
FROM r ASOF LEFT JOIN w ON r.city = w.city AND r.ts >= w.seen"""

#: Queries that would take SQL too long or that it can't express; tests compare them with brute force.
WITHOUT_SQL = ("image_inputs", "image_runs")

#: Both models' squares of every good image, by place and channel.
CANVASES = PIXELS + IMAGE_ERRORS + f""", n AS (SELECT * FROM (VALUES ('detector', {THUMBNAILS[0]}), ('classifier', {THUMBNAILS[1]})) AS t(part, side)),
g AS MATERIALIZED (
  SELECT run_id, part, side AS n, w, h,
    CASE WHEN part = 'detector' THEN CASE WHEN w > h THEN side ELSE trunc(side * (w / h))::INT END ELSE trunc(w * (side / least(w, h)))::INT END AS nw,
    CASE WHEN part = 'detector' THEN CASE WHEN w > h THEN trunc(side / (w / h))::INT ELSE side END ELSE trunc(h * (side / least(w, h)))::INT END AS nh
  FROM f, n WHERE why = ''
),
taps AS MATERIALIZED (SELECT DISTINCT size, out, o, i, k FROM ({TAPS.format(size="w", out="nw")} UNION ALL {TAPS.format(size="h", out="nh")})),
across AS (
  SELECT g.run_id, part, p // g.w AS y, t.o AS x, c, least(255, greatest(0, (2097152 + sum(v * k)::BIGINT) >> 22)) AS v
  FROM px JOIN g USING (run_id) JOIN taps t ON t.size = g.w AND t.out = g.nw AND t.i = p % g.w GROUP BY ALL
),
small AS (
  SELECT a.run_id, a.part, t.o AS y, x, c, least(255, greatest(0, (2097152 + sum(v * k)::BIGINT) >> 22)) AS v
  FROM across a JOIN g USING (run_id, part) JOIN taps t ON t.size = g.h AND t.out = g.nh AND t.i = a.y GROUP BY ALL
),
filled AS (
  SELECT g.run_id, g.part, n, place, c.c, coalesce(s.v, CASE WHEN g.part = 'detector' THEN 114 ELSE 0 END) AS v
  FROM (SELECT *, unnest(range(n * n)) AS place FROM g) g CROSS JOIN range(3) AS c(c)
  LEFT JOIN small s ON s.run_id = g.run_id AND s.part = g.part AND s.c = c.c
    AND s.x = place % n + CASE WHEN g.part = 'detector' THEN -((n - nw) // 2) ELSE floor((nw - n) / 2)::INT END
    AND s.y = place // n + CASE WHEN g.part = 'detector' THEN -((n - nh) // 2) ELSE floor((nh - n) / 2)::INT END
),
"""

ORACLE: dict[str, str] = {
    "cloud_factor": physics_query("cloud_factor"),
    "wind_cooling": physics_query("wind_cooling_factor"),
    "irradiance": physics_query("irradiance_wm2"),
    "module_temperature": physics_query("module_temp_c"),
    "soiling_ratio": observed().sql(f"SELECT DISTINCT label, {SOILED} AS soiling_ratio FROM @"),
    "temperature_loss": physics_query("temp_loss_pct"),
    "effective_efficiency": physics_query("effective_efficiency"),
    "compute_physics": physics_query(
        "cloud_factor", "wind_cooling_factor", "irradiance_wm2", "module_temp_c", "soiling_ratio", "temp_loss_pct", "effective_efficiency"
    ),
    "as_of_default": _as_of(),
    "feature_vector_raw": with_features(observed()).sql(f"SELECT run_id, {', '.join(RAW)} FROM @"),
    "feature_vector_model": with_features(observed()).sql(f"SELECT run_id, {', '.join(MODEL_COLUMNS)} FROM @"),
    "feature_gap_fill": with_features(observed()).sql(f"SELECT run_id, {', '.join(MODEL_COLUMNS)}, 0e0 AS panel_tilt, 0e0 AS panel_azimuth FROM @"),
    "feature_errors": validated(faulty()).sql(f"SELECT run_id, feature_status, {feature_message()} AS message FROM @ WHERE feature_status <> 'VALID'"),
    "report_json": report_texts(),
    "validate_nan": validated(faulty()).sql("SELECT run_id, array_to_string(nan_columns, ',') AS nan_columns FROM @ WHERE feature_status = 'NAN'"),
    "validate_ranges": validated(faulty()).sql("SELECT run_id, array_to_string(ranges_, ',') AS out_of_range FROM @ WHERE len(ranges_) > 0"),
    "validate_consistency": faulty().sql(f"SELECT run_id, irradiance_wm2, module_temp_c, ambient_temp_c FROM @ WHERE {ODD}"),
    "validation_report": validated(faulty()).sql(
        "SELECT feature_status, count(*) AS n, sum(n_violations)::BIGINT AS n_violations FROM @ GROUP BY 1"
    ),
    "input_validation": With("i", SCALARS).sql(f"SELECT run_id, coalesce({INPUT_ERROR}, '') AS input_error FROM @"),
    "finite_check": With("i", SCALARS).sql(
        "SELECT " + ", ".join(f"count(*) FILTER (isnan({c}) OR isinf({c})) AS bad_{c.rstrip('_')}" for c in ("panel_age", "voltage", "current_")) + " FROM @"
    ),
    "default_city": With("r", TEXTS).sql("SELECT run_id, coalesce(nullif(raw, ''), 'Chennai') AS city FROM @"),
    "ui_bounds": With("i", SCALARS).sql(
        f"SELECT run_id, panel_age, installation_type FROM @ WHERE panel_age BETWEEN 0 AND 40 AND maintenance_count BETWEEN 0 AND 50 "
        f"AND voltage BETWEEN 0 AND 1000 AND current_ BETWEEN 0 AND 100 AND list_contains({listed(MOUNT_TYPES)}, installation_type)"
    ),
    "city_validate": With("r", TEXTS).sql(f"SELECT run_id, {city_of('raw')} AS city FROM @"),
    "city_sanitize": With("r", TEXTS).sql(
        f"SELECT run_id, left(trim(regexp_replace(regexp_replace(raw, {CONTROL}, ' ', 'g'), '{SPACE}+', ' ', 'g')), 100) AS city FROM @"
    ),
    "log_sanitize": With("r", TEXTS)
    .add(kept=f"regexp_replace(raw, {CONTROL}, '', 'g')")
    .sql("SELECT run_id, CASE WHEN length(kept) > 200 THEN left(kept, 200) || '...' ELSE kept END AS line FROM @"),
    "weather_parse": weather().sql(
        "SELECT run_id, name_ AS city, temp AS ambient_temp_c, (e % 101)::DOUBLE AS humidity_pct, (e % 40)::DOUBLE AS wind_speed_ms, "
        "(e % 101)::DOUBLE AS cloud_cover_pct, (950 + e % 100)::DOUBLE AS pressure_hpa, (e % 181 - 90)::DOUBLE AS latitude, "
        "(e % 361 - 180)::DOUBLE AS longitude, 'sky ' || e % 9 AS description, 1697904000 + e * 60 AS observed_s FROM @ WHERE ok"
    ),
    "weather_fallback": weather().sql(
        "SELECT run_id, NOT ok AND NOT crashed AS degraded, crashed, coalesce(CASE WHEN ok THEN name_ ELSE coalesce(clean, city) END, '') AS weather_city, "
        f"{defaulted('ambient_temp_c', 'temp')}, {defaulted('pressure_hpa', '950 + e % 100')} FROM @"
    ),
    "weather_join": observed().sql(
        "SELECT o.run_id, o.city, coalesce(n.n_nationkey*1.5e0, 25e0) AS ambient_temp_c, coalesce(n.n_nationkey + 1000e0, 1013.25e0) AS pressure_hpa, "
        "coalesce(n.n_nationkey*7e0, 0e0) AS longitude, n.n_nationkey IS NOT NULL AS fetch_successful "
        "FROM @ o LEFT JOIN nation n ON n.n_name = o.city"
    ),
    "weather_join_all": observed().sql(
        "SELECT o.run_id, o.city, coalesce(n.n_nationkey*1.5e0, 25e0) AS ambient_temp_c, coalesce(n.n_nationkey + 1000e0, 1013.25e0) AS pressure_hpa, "
        "coalesce(n.n_nationkey*7e0, 0e0) AS longitude, n.n_nationkey IS NOT NULL AS fetch_successful FROM @ o LEFT JOIN nation n ON n.n_name = o.city"
    ),
    "weather_as_of": AS_OF,
    "weather_as_of_stream": AS_OF,
    "weather_live": observed()
    .add(n="length(city)", ok_="NOT starts_with(city, 'I') AND NOT starts_with(city, 'U')")
    .sql(
        "SELECT run_id, city, "
        + ", ".join(f"CASE WHEN ok_ THEN {v} ELSE {num(WEATHER_DEFAULTS[c])} END AS {c}" for c, v in (
            ("ambient_temp_c", "n*1.25e0"), ("humidity_pct", "n*3e0"), ("wind_speed_ms", "n*0.5e0"), ("cloud_cover_pct", "n*4e0"),
            ("pressure_hpa", "n + 1000e0"), ("latitude", "n - 10e0"), ("longitude", "n*7e0"),
        ))
        + ", ok_ AS fetch_successful FROM @"
    ),
    "detection_flatten": With("b", BOXES).sql(
        "SELECT run_id, (row_number() OVER (PARTITION BY run_id ORDER BY ord, l_quantity, l_extendedprice, confidence, class_id) - 1)::INT AS ord, l_quantity AS x2, confidence, class_id FROM @"
    ),
    "detection_summary": With("b", BOXES).sql(
        "SELECT o_orderkey AS run_id, count(b.ord) AS panel_count, coalesce(max(b.confidence), 0e0) AS best_confidence, count(b.ord) > 0 AS detection_successful "
        "FROM orders LEFT JOIN @ b ON b.run_id = o_orderkey GROUP BY 1"
    ),
    "detection_summary_all": With("b", BOXES).sql(
        "SELECT o_orderkey AS run_id, count(b.ord) AS panel_count, coalesce(max(b.confidence), 0e0) AS best_confidence, count(b.ord) > 0 AS detection_successful "
        "FROM orders LEFT JOIN @ b ON b.run_id = o_orderkey GROUP BY 1"
    ),
    "detection_validate": With("b", BOXES)
    .swap(confidence="CASE WHEN run_id % 13 = 0 THEN confidence + 1 WHEN run_id % 29 = 0 THEN 'NaN'::DOUBLE ELSE confidence END")
    .sql(
        "SELECT run_id, ord, CASE WHEN isnan(confidence) THEN 'confidence non-finite' ELSE 'confidence out of range [0,1]' END AS error "
        "FROM @ WHERE isnan(confidence) OR confidence < 0 OR confidence > 1"
    ),
    "softmax": PROBS.sql("SELECT run_id, class_id, p FROM @"),
    "argmax_label": With("l", LOGITS % 8)
    .add(class_id="list_position(logits, list_max(logits))::INT - 1")
    .sql(f"SELECT run_id, class_id, coalesce(list_extract({listed(LABELS)}, class_id + 1), 'Unknown') AS label FROM @"),
    "probability_map": PROBS.sql(f"SELECT run_id, list_extract({listed(LABELS)}, class_id + 1) AS label, p FROM @"),
    "classification_validate": With("l", LOGITS % 6).sql(
        "SELECT run_id, CASE WHEN run_id % 11 = 0 THEN 'non-finite values' WHEN list_min(logits) + 0.2e0 < 0 THEN 'negative values' "
        "WHEN list_max(logits) + 0.2e0 > 1 THEN 'confidence out of range [0,1]' ELSE '' END AS error FROM @"
    ),
    "tensor_normalize": _channels(),
    "letterbox_geometry": geometry(
        ", s AS (SELECT *, CASE WHEN w/h > 1 THEN 640 ELSE floor(640*(w/h)) END::INT AS new_w, CASE WHEN w/h > 1 THEN floor(640/(w/h)) ELSE 640 END::INT AS new_h FROM g) "
        "SELECT run_id, new_w, new_h, floor((640 - new_w)/2e0)::INT AS offset_x, floor((640 - new_h)/2e0)::INT AS offset_y FROM s"
    ),
    "center_crop_geometry": geometry(
        ", s AS (SELECT *, floor(w*(224/least(w, h)))::INT AS new_w, floor(h*(224/least(w, h)))::INT AS new_h FROM g) "
        'SELECT run_id, new_w, new_h, floor((new_w - 224)/2e0)::INT AS "left", floor((new_h - 224)/2e0)::INT AS top FROM s'
    ),
    "detection_nms": """WITH RECURSIVE b AS (
  SELECT l_orderkey AS run_id, (l_suppkey % 4 * 10)::DOUBLE AS x1, (l_partkey % 4 * 10)::DOUBLE AS y1, l_suppkey % 4 * 10 + l_quantity + 40e0 AS x2,
    (l_partkey % 4 * 10 + l_partkey % 50)::DOUBLE + 40e0 AS y2, ((l_orderkey * 31 + l_linenumber * 17 + l_partkey) % 100)::DOUBLE / 100e0 AS confidence,
    (l_suppkey % 2)::INT AS class_id, l_linenumber,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, x1, y1, x2, y2, confidence, class_id) - 1 AS ord FROM lineitem
),
r AS MATERIALIZED (
  SELECT *, {'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'c': class_id, 'confidence': confidence, 'ord': ord} AS box,
    row_number() OVER (PARTITION BY run_id ORDER BY confidence DESC, ord) AS turn FROM b WHERE confidence > 0.45e0
),
fold AS (
  SELECT run_id, turn, [box] AS kept FROM r WHERE turn = 1
  UNION ALL
  SELECT r.run_id, r.turn, CASE WHEN len(list_filter(kept, lambda k: k.c = r.class_id AND
      (CASE WHEN least(k.x2, r.x2) > greatest(k.x1, r.x1) THEN least(k.x2, r.x2) - greatest(k.x1, r.x1) ELSE 0e0 END
       * CASE WHEN least(k.y2, r.y2) > greatest(k.y1, r.y1) THEN least(k.y2, r.y2) - greatest(k.y1, r.y1) ELSE 0e0 END)
      / ((k.x2 - k.x1) * (k.y2 - k.y1) + (r.x2 - r.x1) * (r.y2 - r.y1)
         - CASE WHEN least(k.x2, r.x2) > greatest(k.x1, r.x1) THEN least(k.x2, r.x2) - greatest(k.x1, r.x1) ELSE 0e0 END
         * CASE WHEN least(k.y2, r.y2) > greatest(k.y1, r.y1) THEN least(k.y2, r.y2) - greatest(k.y1, r.y1) ELSE 0e0 END) > 0.5e0)) > 0
    THEN kept ELSE list_append(kept, r.box) END
  FROM fold JOIN r ON r.run_id = fold.run_id AND r.turn = fold.turn + 1
),
done AS (SELECT run_id, arg_max(kept, turn) AS kept FROM fold GROUP BY run_id)
SELECT run_id, (p - 1)::INT AS position, kept[p].ord::INT AS ord, kept[p].c AS class_id, kept[p].confidence AS confidence, kept[p].x2 AS x2
FROM (SELECT *, unnest(range(1, len(kept) + 1)) AS p FROM done)""",
    "image_models": CANVASES
    + f"""cells AS (
  SELECT run_id, sum(v) / (3e0 * 3e0 * 3e0 * 255e0) AS light FROM filled WHERE part = 'detector' GROUP BY run_id, place % n // 3, place // n // 3
),
n_ AS (SELECT run_id, count(*) FILTER (light > 0.45e0) AS panel_count, coalesce(max(light) FILTER (light > 0.45e0), 0e0) AS best FROM cells GROUP BY run_id),
channels AS (
  SELECT run_id, c, avg(t) AS m, sqrt(avg(t * t) - avg(t) * avg(t)) AS d
  FROM (SELECT run_id, c, (v / 255e0 - {listed_numbers(IMAGE_MEAN)}[c + 1]::DOUBLE) / {listed_numbers(IMAGE_STD)}[c + 1]::DOUBLE AS t FROM filled WHERE part = 'classifier')
  GROUP BY run_id, c
),
scores AS (SELECT run_id, list_concat(list(m ORDER BY c), list(d ORDER BY c)) AS l FROM channels GROUP BY run_id),
best AS (
  SELECT run_id, list_extract({listed(LABELS)}, list_position(l, list_max(l))::INT) AS label, 1e0 / list_sum(list_transform(l, lambda x: exp(x - list_max(l)))) AS p FROM scores
)
SELECT f.run_id, why AS error, coalesce(panel_count, 0)::INT AS panel_count, coalesce(best, 0e0) AS detection_confidence,
  coalesce(label, 'Unknown') AS label, coalesce({rounded("p", 3)}, 0e0) AS class_confidence
FROM f LEFT JOIN n_ USING (run_id) LEFT JOIN best USING (run_id)""",
    "image_decode": PIXELS + IMAGE_ERRORS + " SELECT run_id, why = '' AS ok, why AS error, CASE WHEN why = '' THEN w END AS width, CASE WHEN why = '' THEN h END AS height, "
    "m.md5 AS pixels_md5 FROM f LEFT JOIN (SELECT run_id, md5(unhex(string_agg(printf('%02x', v), '' ORDER BY p, c))) AS md5 FROM px GROUP BY run_id) m USING (run_id)",
    "image_thumbnails": CANVASES
    + """sums AS (SELECT run_id, part, md5(unhex(string_agg(printf('%02x', v), '' ORDER BY place, c))) AS md5 FROM filled GROUP BY ALL)
SELECT f.run_id, why AS error, d.md5 AS detector_md5, k.md5 AS classifier_md5
FROM f LEFT JOIN sums d ON d.run_id = f.run_id AND d.part = 'detector' LEFT JOIN sums k ON k.run_id = f.run_id AND k.part = 'classifier'""",
    "prediction_postprocess": with_loss(With("o", RAW_OUTPUTS), "raw").sql("SELECT run_id, efficiency_loss_pct, estimated_output_w, prediction_successful FROM @"),
    "prediction_validate": With("o", RAW_OUTPUTS).sql(
        "SELECT run_id, CASE WHEN raw IS NULL THEN 'Invalid prediction output' ELSE 'Prediction output must be finite' END AS error "
        "FROM @ WHERE raw IS NULL OR isnan(raw) OR isinf(raw)"
    ),
    "rule_fault_class": rule(0),
    "rule_efficiency_loss": rule(1),
    "rule_module_temp": rule(2),
    "rule_low_irradiance": rule(3),
    "recommendations_long": ruled().sql("SELECT run_id, position::INT AS position, severity, message, action FROM @"),
    "overall_severity": reports().sql("SELECT run_id, overall_severity FROM @"),
    "recommendation_report": reports().sql("SELECT run_id, overall_severity, summary, recommendation, priority, n_issues::INT AS n_issues FROM @"),
    "top_action": reports().sql("SELECT run_id, recommendation FROM @"),
    "severity_counts": reports().sql("SELECT city, overall_severity, count(*) AS n, min(estimated_output_w) AS least_output_w FROM @ GROUP BY 1, 2"),
    "pipeline_run": runs().sql(
        f"SELECT run_id, CASE WHEN error_stage = 'none' THEN 'SUCCESS' ELSE 'ERROR' END AS status, error_stage, city, "
        f"CASE WHEN {EARLY % ''} THEN 'Unknown' ELSE label END AS label, "
        + ", ".join(f"CASE WHEN {EARLY % stage} THEN {default} ELSE {c} END AS {c}" for c, default, stage in (
            ("irradiance_wm2", "0e0", ", 'weather'"), ("module_temp_c", "25e0", ", 'weather'"),
        ))
        + ", CASE WHEN error_stage <> 'none' THEN 0e0 ELSE efficiency_loss_pct END AS efficiency_loss_pct"
        + f", CASE WHEN error_stage <> 'none' THEN 'OK' ELSE sev_ END AS overall_severity, CASE WHEN error_stage <> 'none' THEN {q(NO_ACTION)} ELSE act_ END AS recommendation FROM @"
    ),
    "pipeline_errors": runs()
    .add(
        error_type="CASE error_stage WHEN 'image' THEN 'ImageValidationError' WHEN 'inputs' THEN 'InputValidationError' WHEN 'weather' THEN 'UnexpectedError' WHEN 'features' THEN 'FeatureValidationError' ELSE 'PredictionError' END",
        error_message=f"CASE error_stage WHEN 'image' THEN 'Image validation failed: no image data' WHEN 'inputs' THEN 'Input validation failed: ' || input_error "
        f"WHEN 'detect' THEN '[YOLO] Prediction failed: confidence non-finite' WHEN 'classify' THEN '[MobileNet] Prediction failed: negative values' "
        f"WHEN 'features' THEN 'Feature validation failed: ' || ({feature_message()}) ELSE {q(GENERIC)} END",
    )
    .sql("SELECT error_stage, error_type, error_message, count(*) AS n, min(run_id) AS first_run FROM @ WHERE error_stage <> 'none' GROUP BY 1, 2, 3"),
    "run_metrics": runs().sql("SELECT error_stage AS stage, count(*) AS rows, true AS timed FROM @ GROUP BY 1"),
    "ui_metrics": predicted().sql(
        "SELECT run_id, printf('%.1f', detection_confidence*100e0) || '%' AS confidence, printf('%.1f', ambient_temp_c) || ' °C' AS temperature, "
        "printf('%.0f', irradiance_wm2) || ' W/m²' AS irradiance, printf('%.2f', soiling_ratio) AS soiling, printf('%.0f', estimated_output_w) || ' W' AS output FROM @"
    ),
    "severity_colour": reports().sql(
        "SELECT DISTINCT overall_severity, CASE overall_severity " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in COLOURS.items()) + " ELSE 'info' END AS colour FROM @"
    ),
    "manifest_verify": ENTRY.sql(
        "SELECT ord, CASE WHEN path = '' THEN 'artifact entry is missing a valid ''path''' WHEN NOT regexp_full_match(sha, '[0-9a-fA-F]{64}') THEN 'missing valid SHA-256 digest' "
        "WHEN path LIKE '/%' THEN 'artifact path must be relative to the manifest directory' WHEN path LIKE 'm/../../%' THEN 'artifact path escapes the manifest directory' "
        "WHEN NOT there THEN 'artifact missing' WHEN lower(sha) <> digest THEN 'SHA-256 mismatch' ELSE '' END AS error FROM @"
    ),
    "manifest_files": ENTRY.sql(
        "SELECT manifest_id, ok, position, line FROM (SELECT manifest_id, len(lines) = 0 AS ok, unnest(range(len(lines)))::INT AS position, unnest(lines) AS line FROM "
        "(SELECT 1 + ord % 3 AS manifest_id, list_filter(list(CASE WHEN error <> '' THEN CASE WHEN path = '' THEN '' ELSE path || ': ' END || error END ORDER BY ord), lambda v: v IS NOT NULL) AS lines FROM "
        "(SELECT ord, CASE WHEN k = 7 THEN 'link/1.bin' ELSE path END AS path, CASE WHEN path = '' THEN 'artifact entry is missing a valid ''path''' "
        "WHEN NOT regexp_full_match(sha, '[0-9a-fA-F]{64}') THEN 'missing valid SHA-256 digest' "
        "WHEN path LIKE '/%' THEN 'artifact path must be relative to the manifest directory' WHEN path LIKE 'm/../../%' OR k = 7 THEN 'artifact path escapes the manifest directory' "
        "WHEN NOT there THEN 'artifact missing' WHEN lower(sha) <> digest THEN 'SHA-256 mismatch' ELSE '' END AS error FROM @) GROUP BY 1))"
    ),
    "missing_artifacts": ENTRY.sql("SELECT ord, path FROM @ WHERE NOT there"),
    "artifact_readiness": """WITH m AS (SELECT count(*) FILTER (r_regionkey % 2 <> 0) AS n, string_agg('"' || r_name || '"', ',' ORDER BY r_name) FILTER (r_regionkey % 2 <> 0) AS names FROM region)
 SELECT '{"inference_readiness":"' || CASE WHEN n = 0 THEN 'ready' ELSE 'not_ready' END || '","liveness":"ok","missing_artifacts":[' || coalesce(names, '') || ']}' AS payload,
 CASE WHEN n = 0 THEN 0 ELSE 2 END AS exit_code FROM m""",
    "predict_pandas": with_physics(observed())
    .add(l_="CASE WHEN change_ > 0 THEN change_ ELSE 0e0 END")
    .add(m_="100e0*(1e0-soiling_ratio*(1e0-l_/100e0))")
    .step("m6_", "m_", 6)
    .step("raw_prediction", "m6_", 4)
    .sql("SELECT run_id, raw_prediction FROM @"),
    "regression_fit": boosted(_stumps()),
    "regression_predictions": boosted(
        f"SELECT run_id, raw_prediction, {clamped('raw_prediction', 0, 100)} AS efficiency_loss_pct, true AS prediction_successful "
        f"FROM (SELECT run_id, (y - r)::DOUBLE / 1000000e0 AS raw_prediction FROM x JOIN r{ROUNDS} USING (run_id) WHERE f = 0)"
    ),
    "stream_equals_batch": physics_query("irradiance_wm2", "effective_efficiency"),
}
