"""DuckDB SQL that says the same as each query of the catalog (where SQL can)."""

from __future__ import annotations

from costweave import fixed_values as fv
from costweave.functions.numbers import NUMBER_PATTERN
from costweave.sources.stand_ins import CPI_BASE_YEAR, CPI_YEAR

EXCLUDED = "('O1', 'O7', 'O21')"
SHARES = list(fv.SUBSYSTEM_SHARES)
STEMS = [s.removesuffix("_pct") for s in SHARES]


def r(expression: str, name: str, decimals: int = 6) -> str:
    return f"round({expression}, {decimals}) + 0.0 AS {name}"


def rs(names, decimals: int = 6, table: str = "") -> str:
    return ", ".join(r(f"{table}{n}", n, decimals) for n in names)


def number(text: str) -> str:
    return f"CASE WHEN regexp_matches({text}, '{NUMBER_PATTERN}') THEN TRY_CAST(trim({text}) AS DOUBLE) END"


def dollars(text: str) -> str:
    return number(f"regexp_replace({text}, '[$,]', '', 'g')")


# ---- views ------------------------------------------------------------------

PROJECTS = f"""
lines AS (
  SELECT l_orderkey, sum(l_quantity) AS length_km,
         sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0 END) AS tunnel_km,
         count(*)::DOUBLE AS num_stations, year(max(l_shipdate)) AS ship_year
  FROM lineitem GROUP BY l_orderkey),
projects AS (
  SELECT o_orderkey AS project_id, o_custkey AS customer_id, n_name AS country, c_name AS city,
         'O' || o_orderkey AS line, o_orderpriority AS mode, length_km, tunnel_km,
         tunnel_km / nullif(length_km, 0) AS tunnel_pct, num_stations,
         year(o_orderdate)::DOUBLE AS start_year,
         greatest(year(o_orderdate), ship_year)::DOUBLE AS end_year,
         CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.0 END::DOUBLE AS is_regional_rail,
         o_totalprice / nullif(length_km, 0) AS {fv.TARGET}
  FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

# dirty text, one column each; NULL in, NULL out
RAW_PROJECTS = PROJECTS + f""",
raw_projects AS (
  SELECT project_id, line, mode AS phase,
    CASE WHEN project_id % 10 <> 9 THEN country END AS country,
    CASE WHEN project_id % 100 <> 9 THEN city END AS city,
    CASE project_id % 10 WHEN 5 THEN '1997?' WHEN 6 THEN ' 1997 ' ELSE start_year::BIGINT::VARCHAR END AS start_year,
    end_year::BIGINT::VARCHAR AS end_year, is_regional_rail,
    CASE WHEN length_km IS NOT NULL THEN
      CASE project_id % 10 WHEN 7 THEN '12d' WHEN 8 THEN '1_000' ELSE printf('%.2f', round(length_km, 2)) END END AS length_km,
    CASE WHEN project_id % 2 = 0 THEN printf('%.4f', round(tunnel_pct * 100, 4)) ELSE printf('%.6f', round(tunnel_pct, 6)) END AS tunnel_pct,
    printf('%.2f', round(tunnel_km, 2)) AS tunnel_km,
    CASE WHEN num_stations IS NOT NULL THEN CASE project_id % 10
      WHEN 0 THEN num_stations::BIGINT::VARCHAR || '/' || (num_stations::BIGINT + 2)::VARCHAR
      WHEN 1 THEN num_stations::BIGINT::VARCHAR || '/x'
      WHEN 2 THEN 'TBD'
      WHEN 3 THEN ' ' || num_stations::BIGINT::VARCHAR || ' '
      WHEN 4 THEN NULL
      ELSE num_stations::BIGINT::VARCHAR END END AS num_stations,
    printf('%.6f', round({fv.TARGET}, 6)) AS {fv.TARGET}
  FROM projects)"""

SLASH = (
    f"CASE WHEN num_stations LIKE '%/%' THEN "
    f"({number('split_part(num_stations, chr(47), 1)')} + {number('split_part(num_stations, chr(47), 2)')}) / 2 "
    f"ELSE {number('num_stations')} END"
)

SUBSYSTEMS = f"""
subsystem_totals AS (
  SELECT o_custkey AS customer_id, sum(l_quantity) AS length_miles,
         sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0 END) AS tunnel_miles,
         round(sum(l_extendedprice), 2) AS project_cost,
         {", ".join(f"round(sum(l_extendedprice) FILTER (WHERE p_size % 8 = {i}), 2) AS {s}" for i, s in enumerate(STEMS))}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_custkey),
subsystems AS (
  SELECT customer_id, c_name AS project, c_mktsegment AS mode, length_miles, tunnel_miles, project_cost,
         {", ".join(STEMS)}, {", ".join(f"{s} / project_cost AS {s}_pct" for s in STEMS)}
  FROM subsystem_totals JOIN customer ON customer_id = c_custkey)"""


def _dollar_text(expression: str) -> str:
    return f"CASE WHEN customer_id % 11 = 0 THEN 'n/a' ELSE '$' || format('{{:,.2f}}', {expression}) END"


RAW_SUBSYSTEMS = SUBSYSTEMS + f""",
raw_subsystems AS (
  SELECT customer_id, project, mode, length_miles, tunnel_miles,
    {_dollar_text("project_cost")} AS project_cost,
    {_dollar_text("round(project_cost / length_miles, 2)")} AS cost_per_mile,
    {_dollar_text("soft_costs")} AS soft_costs,
    {_dollar_text("vehicle_costs")} AS vehicle_costs,
    {_dollar_text("station_costs")} AS station_costs,
    {_dollar_text("guideway_costs")} AS guideway_costs,
    {_dollar_text("round(guideway_costs / length_miles, 2)")} AS guideway_costs_per_mile,
    CASE WHEN customer_id % 13 = 0 THEN soft_costs_pct + 1 ELSE soft_costs_pct END AS soft_costs_pct,
    CASE WHEN customer_id % 13 = 0 THEN guideway_costs_pct + 1 ELSE guideway_costs_pct END AS guideway_costs_pct
  FROM subsystems)"""

RAW_DOLLARS = [
    "project_cost", "cost_per_mile", "soft_costs", "vehicle_costs", "station_costs", "guideway_costs",
    "guideway_costs_per_mile",
]

CPI = f"""
yearly AS (SELECT year(o_orderdate) AS year, round(avg(o_totalprice), 4) AS v FROM orders GROUP BY 1),
cpi AS (SELECT year::INTEGER AS year, (SELECT v FROM yearly WHERE year = {CPI_BASE_YEAR}) / v AS index_2023 FROM yearly)"""
MULTIPLIER = f"(SELECT index_2023 FROM cpi WHERE year = {CPI_YEAR})"

REQUESTS = PROJECTS + """,
per_customer AS (
  SELECT customer_id, avg(length_km) AS length_km, sum(tunnel_km) / nullif(sum(length_km), 0) AS tunnel_pct,
         round(avg(num_stations), 0) AS num_stations, min(start_year) AS start_year, max(end_year) AS end_year,
         sum(is_regional_rail) * 2 > count(is_regional_rail) AS is_regional
  FROM projects GROUP BY customer_id),
requests AS (
  SELECT c_custkey AS request_id,
         CASE WHEN c_custkey % 5 = 1 THEN 'NOWHERE' ELSE n_name END AS country,
         CASE WHEN c_custkey % 3 = 0 THEN 'New City' ELSE c_name END AS city,
         length_km, tunnel_pct,
         CASE WHEN c_custkey % 4 = 0 THEN 0.0 ELSE num_stations END AS num_stations, start_year,
         CASE WHEN c_custkey % 11 = 0 THEN start_year - 1 ELSE end_year END AS end_year,
         coalesce(is_regional, false) AS is_regional,
         CASE WHEN c_custkey % 7 = 0 THEN 'UNKNOWN' ELSE c_mktsegment END AS transit_mode
  FROM customer LEFT JOIN per_customer ON c_custkey = customer_id JOIN nation ON c_nationkey = n_nationkey)"""

PREPARED = f""",
training AS (SELECT * FROM projects WHERE {fv.TARGET} IS NOT NULL AND NOT coalesce(line IN ('Capital Airport Express', 'Tozai Line (Sendai)'), false)),
medians AS (SELECT median(num_stations) AS num_stations, median((start_year + end_year) / 2) AS mid_year FROM training),
prepared AS (
  SELECT project_id, country, city, mode, t.length_km,
         CASE WHEN tunnel_pct > 1 THEN tunnel_pct / 100 ELSE tunnel_pct END AS tunnel_pct,
         coalesce(t.num_stations, m.num_stations) / (length_km + 0.1) AS station_density,
         CASE WHEN length_km > 0 THEN ln(length_km) END AS log_length,
         coalesce(is_regional_rail, 0.0) AS is_regional_rail,
         coalesce((start_year + end_year) / 2, m.mid_year) AS mid_year,
         CASE WHEN {fv.TARGET} > 0 THEN ln({fv.TARGET}) END AS log_cost
  FROM training t, medians m)"""

ENCODERS = f""",
overall AS (SELECT avg(log_cost) AS global_mean FROM prepared),
country_enc AS (
  SELECT country, (sum(log_cost) + {fv.COUNTRY_SMOOTHING} * any_value(global_mean)) / (count(log_cost) + {fv.COUNTRY_SMOOTHING}) AS te,
         count(*) AS freq FROM prepared, overall WHERE country IS NOT NULL GROUP BY country),
city_enc AS (
  SELECT city, (sum(log_cost) + {fv.CITY_SMOOTHING} * any_value(global_mean)) / (count(log_cost) + {fv.CITY_SMOOTHING}) AS te,
         count(*) AS freq FROM prepared, overall WHERE city IS NOT NULL GROUP BY city)"""

LOOKED_UP = """,
looked_up AS (
  SELECT q.*, coalesce(a.te, global_mean) AS country_te, coalesce(a.freq, 1)::DOUBLE AS country_freq,
         coalesce(b.te, a.te, global_mean) AS city_te, coalesce(b.freq, 1)::DOUBLE AS city_freq,
         coalesce(b.freq, 0) AS sample_density
  FROM requests q LEFT JOIN country_enc a ON q.country = a.country LEFT JOIN city_enc b ON q.city = b.city, overall),
scored AS (SELECT *, exp(city_te) AS pred FROM looked_up)"""

FOLDED = f""",
edges AS (SELECT {", ".join(f"quantile_cont(log_cost, {i / fv.COST_BINS}) AS e{i}" for i in range(1, fv.COST_BINS))} FROM prepared),
binned AS (
  SELECT p.*, ({" + ".join(f"(e{i} < log_cost)::INTEGER" for i in range(1, fv.COST_BINS))})::INTEGER AS cost_bin FROM prepared p, edges),
folded AS (
  SELECT *, ((row_number() OVER (PARTITION BY cost_bin ORDER BY md5(project_id || '|{fv.SEED}'), project_id) - 1) % {fv.FOLDS})::INTEGER AS fold
  FROM binned)"""


def fold_encoder(key: str, m: float) -> str:
    """All key x fold pairs, straight from the definition: statistics of the rows outside the fold."""
    return f""",
{key}_fold AS (
  SELECT k.{key}, f.fold, g.global_mean,
         CASE WHEN s.n > 0 THEN (s.total + {m} * g.global_mean) / (s.n + {m}) ELSE g.global_mean END AS te, s.freq
  FROM (SELECT DISTINCT {key} FROM folded WHERE {key} IS NOT NULL) k
  CROSS JOIN (SELECT unnest(range({fv.FOLDS}))::INTEGER AS fold) f
  JOIN (SELECT h.fold, avg(log_cost) AS global_mean FROM folded x JOIN (SELECT unnest(range({fv.FOLDS}))::INTEGER AS fold) h
        ON x.fold <> h.fold GROUP BY h.fold) g ON g.fold = f.fold
  LEFT JOIN (SELECT x.{key}, h.fold, sum(log_cost) AS total, count(log_cost) AS n, count(*) AS freq
        FROM folded x JOIN (SELECT unnest(range({fv.FOLDS}))::INTEGER AS fold) h ON x.fold <> h.fold GROUP BY x.{key}, h.fold) s
    ON s.{key} = k.{key} AND s.fold = f.fold)"""


PREDICTIONS = FOLDED + fold_encoder("city", fv.CITY_SMOOTHING) + """,
predictions AS (
  SELECT project_id, country, mode, f.fold, log_cost, c.te AS pred_log
  FROM folded f JOIN city_fold c ON f.city = c.city AND f.fold = c.fold),
errors AS (
  SELECT *, exp(log_cost) AS true_cost, exp(pred_log) AS pred_cost,
         (exp(pred_log) - exp(log_cost)) / exp(log_cost) AS err, abs((exp(pred_log) - exp(log_cost)) / exp(log_cost)) AS abs_err
  FROM predictions)"""

R2 = "1 - sum((log_cost - pred_log) ^ 2) / nullif(var_pop(log_cost) * count(log_cost), 0)"
Q10 = "greatest(0.0, 1 + quantile_cont(err, 0.1))"
Q90 = f"greatest({Q10} + {fv.MIN_BAND_WIDTH}, 1 + quantile_cont(err, 0.9))"
BANDS = f""",
bands AS (SELECT {Q10} AS q10, {Q90} AS q90 FROM errors)"""

RATIOS = f""",
slots AS (
  SELECT true AS is_global, NULL::VARCHAR AS mode, {", ".join(SHARES)} FROM subsystems
  UNION ALL SELECT false, mode, {", ".join(SHARES)} FROM subsystems WHERE mode IS NOT NULL),
mode_medians AS (
  SELECT is_global, mode, count(*) AS n_projects, {", ".join(f"median({s}) AS {s}" for s in SHARES)} FROM slots GROUP BY is_global, mode),
totals AS (SELECT *, {" + ".join(f"coalesce({s}, 0)" for s in SHARES)} AS total FROM mode_medians),
own AS (
  SELECT is_global, mode, n_projects,
         {", ".join(f"CASE WHEN total > 0 THEN {s} / total ELSE 0.125 END AS {s}" for s in SHARES)} FROM totals),
ratios AS (
  SELECT o.mode, o.is_global, o.n_projects,
         NOT o.is_global AND o.mode = 'MACHINERY' AS forced_global,
         NOT o.is_global AND o.mode <> 'MACHINERY' AND o.n_projects < {fv.SMALL_SAMPLE} AS low_n,
         {", ".join(f"CASE WHEN NOT o.is_global AND o.mode = 'MACHINERY' THEN g.{s} ELSE o.{s} END AS {s}" for s in SHARES)}
  FROM own o, own g WHERE g.is_global),
ratios_long AS (
  {" UNION ALL ".join(
      f"SELECT mode, is_global, n_projects, {i} AS ordinal, '{label}' AS subsystem, {s} AS ratio FROM ratios"
      for i, (s, label) in enumerate(fv.SUBSYSTEM_SHARES.items()))})"""

SPLIT = """,
split AS (
  SELECT s.request_id, s.transit_mode, s.pred, s.length_km, l.ordinal, l.subsystem, l.ratio,
         CASE WHEN known.mode IS NULL THEN 0 ELSE l.n_projects END AS n_projects, known.mode IS NULL AS fallback_used
  FROM scored s LEFT JOIN (SELECT mode FROM ratios WHERE NOT is_global) known ON s.transit_mode = known.mode
  JOIN ratios_long l ON CASE WHEN known.mode IS NULL THEN l.is_global ELSE NOT l.is_global AND l.mode = s.transit_mode END)"""

DEFAULTS = " UNION ALL ".join(f"SELECT '{k}' AS subsystem, {v}::DOUBLE AS ratio" for k, v in fv.DEFAULT_RATIOS.items())

SCORED = REQUESTS + PREPARED + ENCODERS + LOOKED_UP
REPORT_LO, REPORT_HI = f"pred * {fv.DEFAULT_Q10} * ratio", f"pred * {fv.DEFAULT_Q90} * ratio"


def fixed(expression: str, decimals: int) -> str:
    return f"format('{{:.{decimals}f}}', {expression})"


def money(expression: str, decimals: int, suffix: str = "") -> str:
    return f"'$' || format('{{:,.{decimals}f}}', {expression}) || '{suffix}'"


SIMILAR = REQUESTS + f""",
usable AS (SELECT * FROM projects WHERE {fv.TARGET} IS NOT NULL AND length_km IS NOT NULL AND tunnel_pct IS NOT NULL),
pairs AS (
  SELECT q.request_id, p.project_id, coalesce(p.country = q.country AND p.city = q.city, false) AS same_place,
         round(CASE WHEN coalesce(p.country = q.country AND p.city = q.city, false) THEN {fv.LOCATION_WEIGHT} ELSE 0.0 END
           + CASE WHEN coalesce(p.country = q.country, false) THEN {fv.COUNTRY_WEIGHT} ELSE 0.0 END
           + 1 / (1 + abs(ln(p.length_km + 0.5) - ln(q.length_km + 0.5)) * 1.0)
           + 1 / (1 + abs(p.tunnel_pct - q.tunnel_pct) * 3.0), 9) AS score
  FROM requests q, usable p WHERE q.length_km IS NOT NULL AND q.tunnel_pct IS NOT NULL),
ranked AS (
  SELECT request_id, unnest(best, recursive := true) FROM (
    SELECT request_id, list({{'rank': rank, 'score': score, 'project_id': project_id, 'same_place': same_place}}) AS best FROM (
      SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, project_id) AS rank FROM pairs
      QUALIFY rank <= {fv.SIMILAR_PROJECTS}) GROUP BY request_id)),
similar_found AS (
  SELECT r.request_id, r.rank::INTEGER AS rank, r.score, r.same_place, p.*,
         round_even(least(greatest(r.score / {fv.MAX_SIMILARITY} * 100, 0), 100), 0)::INTEGER AS match_percent
  FROM ranked r JOIN projects p ON p.project_id = r.project_id)"""

NAMES = " UNION ALL ".join(f"SELECT '{k}' AS code, '{v}' AS country_name" for k, v in fv.COUNTRY_NAMES.items())

LINEAR = ["tunnel_pct", "station_density", "log_length", "is_regional_rail", "mid_year"]

ORACLES: dict[str, str] = {
    "cleanse_slash": f"""WITH {RAW_PROJECTS}
        SELECT project_id, num_stations AS raw_text, {r(SLASH, 'num_stations')} FROM raw_projects""",
    "cleanse_year_float": f"""WITH {RAW_PROJECTS}
        SELECT project_id, {r(number('start_year'), 'start_year')}, {r(number('length_km'), 'length_km')},
               {r(number('tunnel_pct'), 'tunnel_pct')} FROM raw_projects""",
    "cleanse_dollars": f"""WITH {RAW_SUBSYSTEMS}
        SELECT customer_id, {", ".join(r(dollars(c), c, 2) for c in ["project_cost", "cost_per_mile", "soft_costs"])} FROM raw_subsystems""",
    "clean_projects": f"""WITH {RAW_PROJECTS}
        SELECT country, city, line, phase, {r(number('start_year'), 'start_year')}, {r(number('end_year'), 'end_year')},
               {r('is_regional_rail', 'is_regional_rail')}, {r(number('length_km'), 'length_km')},
               {r(number('tunnel_pct'), 'tunnel_pct')}, {r(number('tunnel_km'), 'tunnel_km')},
               {r(SLASH, 'num_stations')}, {r(number(fv.TARGET), fv.TARGET)}
        FROM raw_projects
        WHERE (country IS NOT NULL OR city IS NOT NULL) AND {fv.TARGET} IS NOT NULL
          AND tunnel_km IS NOT NULL AND tunnel_pct IS NOT NULL""",
    "quality_row_drops": f"""WITH {RAW_PROJECTS}
        SELECT 'country_and_city_missing' AS rule, count(*) FILTER (WHERE country IS NULL AND city IS NULL) AS dropped_rows FROM raw_projects
        UNION ALL SELECT 'target_missing', count(*) FILTER (WHERE {fv.TARGET} IS NULL) FROM raw_projects
          WHERE country IS NOT NULL OR city IS NOT NULL
        UNION ALL SELECT 'tunnel_missing', count(*) FILTER (WHERE tunnel_km IS NULL OR tunnel_pct IS NULL) FROM raw_projects
          WHERE (country IS NOT NULL OR city IS NOT NULL) AND {fv.TARGET} IS NOT NULL""",
    "quality_new_nulls": f"WITH {RAW_PROJECTS} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NOT NULL AND ({parsed}) IS NULL) AS new_nulls FROM raw_projects"
        for c, parsed in [("num_stations", SLASH)] + [
            (c, number(f"{c}::VARCHAR")) for c in fv.PLAIN_NUMBER_COLUMNS if c != "ppp_rate"]),
    "quality_nulls": f"WITH {RAW_SUBSYSTEMS} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE ({dollars(c)}) IS NULL) AS nulls FROM raw_subsystems" for c in RAW_DOLLARS),
    "quality_pct_range": f"WITH {RAW_SUBSYSTEMS} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} < 0 OR {c} > 1) AS out_of_range FROM raw_subsystems"
        for c in ["soft_costs_pct", "guideway_costs_pct"]),
    "quality_known_modes": f"""WITH {SUBSYSTEMS}
        SELECT mode, count(*) AS n_rows, coalesce(mode IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE'), false) AS known FROM subsystems GROUP BY mode""",
    "outlier_exclusion": f"""WITH {PROJECTS}, gaps AS (SELECT * REPLACE (CASE WHEN project_id % 10 <> 6 THEN line END AS line) FROM projects)
        SELECT project_id, line, {r(fv.TARGET, fv.TARGET)} FROM gaps
        WHERE {fv.TARGET} IS NOT NULL AND (line IS NULL OR line NOT IN {EXCLUDED})""",
    "units_mile_to_km": f"""WITH {SUBSYSTEMS}
        SELECT project, {r('length_miles * 1.60934', 'length_km', 4)}, {r('tunnel_miles * 1.60934', 'tunnel_km', 4)} FROM subsystems""",
    "unit_cost_per_km": f"""WITH {RAW_SUBSYSTEMS}
        SELECT customer_id, {r(f"({dollars('cost_per_mile')}) / 1.60934", 'cost_per_km', 4)},
               {r(f"({dollars('guideway_costs_per_mile')}) / 1.60934", 'guideway_costs_per_km', 4)} FROM raw_subsystems""",
    "subsystem_per_km": f"""WITH {SUBSYSTEMS}
        SELECT project, {", ".join(r(f"{c} / nullif(length_miles * 1.60934, 0)", out, 4) for c, out in fv.TOTALS_PER_KM.items() if c in STEMS)}
        FROM subsystems""",
    "cpi_clean": f"WITH {CPI} SELECT year, {r('index_2023', 'index_2023')} FROM cpi",
    "cpi_multiplier": f"WITH {CPI} SELECT {r(MULTIPLIER, 'multiplier')}",
    "inflate_costs": f"""WITH {SUBSYSTEMS}, {CPI}
        SELECT project, {", ".join(r(f"{c} * {MULTIPLIER}", f"{c}_2023", 2) for c in fv.DOLLAR_COLUMNS if c in ["project_cost", *STEMS])} FROM subsystems""",
    "base_features": f"""WITH {PROJECTS}, scaled AS (
          SELECT * REPLACE (CASE WHEN project_id % 2 = 0 THEN tunnel_pct * 100 ELSE tunnel_pct END AS tunnel_pct) FROM projects)
        SELECT project_id, {r('CASE WHEN tunnel_pct > 1 THEN tunnel_pct / 100 ELSE tunnel_pct END', 'tunnel_pct')},
               {r('num_stations / (length_km + 0.1)', 'station_density')},
               {r('CASE WHEN length_km > 0 THEN ln(length_km) END', 'log_length')},
               {r('(start_year + end_year) / 2', 'mid_year')}, {r('coalesce(is_regional_rail, 0.0)', 'is_regional_rail')} FROM scaled""",
    "train_medians": f"""WITH {PROJECTS}, gaps AS (
          SELECT * REPLACE (CASE WHEN project_id % 10 <> 4 THEN num_stations END AS num_stations,
                            CASE WHEN project_id % 10 <> 5 THEN start_year END AS start_year) FROM projects)
        SELECT {r('median(num_stations)', 'num_stations')}, {r('median((start_year + end_year) / 2)', 'mid_year')}
        FROM gaps WHERE {fv.TARGET} IS NOT NULL AND line NOT IN {EXCLUDED}""",
    "median_impute": f"""WITH {PROJECTS}, gaps AS (
          SELECT * REPLACE (CASE WHEN project_id % 10 <> 4 THEN num_stations END AS num_stations,
                            CASE WHEN project_id % 10 <> 5 THEN start_year END AS start_year) FROM projects),
        kept AS (SELECT * FROM gaps WHERE {fv.TARGET} IS NOT NULL AND line NOT IN {EXCLUDED}),
        m AS (SELECT median(num_stations) AS s, median((start_year + end_year) / 2) AS y FROM kept)
        SELECT project_id, {r('coalesce(num_stations, s)', 'num_stations')},
               {r('coalesce(num_stations, s) / (length_km + 0.1)', 'station_density')},
               {r('coalesce((start_year + end_year) / 2, y)', 'mid_year')}, {r(f'ln({fv.TARGET})', 'log_cost')} FROM kept, m""",
    "target_encode_country": f"WITH {PROJECTS} {PREPARED} {ENCODERS} SELECT country, {r('te', 'te')} FROM country_enc",
    "target_encode_city": f"WITH {PROJECTS} {PREPARED} {ENCODERS} SELECT city, {r('te', 'te')} FROM city_enc",
    "target_encode_place": f"""WITH {PROJECTS} {PREPARED} {ENCODERS}
        SELECT country, mode, {r('(sum(log_cost) + 10.0 * any_value(global_mean)) / (count(log_cost) + 10.0)', 'te')}, count(*) AS freq
        FROM prepared, overall GROUP BY country, mode""",
    "frequency_encode": f"""WITH {PROJECTS} {PREPARED} {ENCODERS}
        SELECT project_id, p.country, {r('te', 'country_te')}, freq AS country_freq FROM prepared p JOIN country_enc e ON p.country = e.country""",
    "two_level_fallback": f"""WITH {SCORED}
        SELECT request_id, country, city, {rs(['country_te', 'country_freq', 'city_te', 'city_freq'])} FROM looked_up""",
    "market_context": f"""WITH {SCORED}
        SELECT request_id, {r('city_te', 'city_baseline')}, {r('country_te', 'country_baseline')}, sample_density FROM looked_up""",
    "market_context_text": f"""WITH {SCORED}
        SELECT request_id, {money('exp(city_te)', 0, ' M/km')} AS city_baseline_text,
               {money('exp(country_te)', 0, ' M/km')} AS country_baseline_text, sample_density || ' Projects' AS sample_density_text FROM looked_up""",
    "quantile_bins": f"WITH {PROJECTS} {PREPARED} {FOLDED} SELECT project_id, cost_bin FROM binned",
    "stratified_folds": f"WITH {PROJECTS} {PREPARED} {FOLDED} SELECT project_id, cost_bin, fold FROM folded",
    "oof_target_encoding": f"""WITH {PROJECTS} {PREPARED} {FOLDED} {fold_encoder('city', fv.CITY_SMOOTHING)}
        SELECT city, fold, {r('te', 'te')}, freq FROM city_fold""",
    "oof_rows_encoded": f"""WITH {PROJECTS} {PREPARED} {FOLDED} {fold_encoder('city', fv.CITY_SMOOTHING)} {fold_encoder('country', fv.COUNTRY_SMOOTHING)}
        SELECT project_id, f.fold, {r('a.te', 'country_te')}, {r('coalesce(a.freq, 1)', 'country_freq')},
               {r('b.te', 'city_te')}, {r('coalesce(b.freq, 1)', 'city_freq')}
        FROM folded f JOIN country_fold a ON f.country = a.country AND f.fold = a.fold
        JOIN city_fold b ON f.city = b.city AND f.fold = b.fold""",
    "metrics_overall": f"""WITH {PROJECTS} {PREPARED} {PREDICTIONS}
        SELECT count(*) AS n, {r(R2, 'r2_log')}, {r('sqrt(avg((log_cost - pred_log) ^ 2))', 'rmse_log')},
               {r('avg(abs(log_cost - pred_log))', 'mae_log')}, {r('median(abs_err) * 100', 'mdape')},
               {r('median(err) * 100', 'median_bias_pct')},
               {r(f'avg(CASE WHEN abs_err < {fv.SUCCESS_ERROR} THEN 1.0 ELSE 0.0 END) * 100', 'success_30')},
               {r(Q10, 'q10_multiplier')}, {r(Q90, 'q90_multiplier')} FROM errors""",
    "metrics_by_fold": f"""WITH {PROJECTS} {PREPARED} {PREDICTIONS}
        SELECT fold, count(*) AS n, {r(R2, 'r2_log')}, {r('avg(abs(log_cost - pred_log))', 'mae_log')} FROM errors GROUP BY fold""",
    "bands_by_mode": f"""WITH {PROJECTS} {PREPARED} {PREDICTIONS}
        SELECT mode, count(*) AS n, {r(Q10, 'q10_multiplier')}, {r(Q90, 'q90_multiplier')} FROM errors
        GROUP BY mode HAVING count(*) >= {fv.MIN_MODE_ROWS}""",
}

_COUNTRY_REPORT = f"""
        SELECT country, count(*) AS n, {r('median(true_cost)', 'median_true', 4)}, {r('median(pred_cost)', 'median_pred', 4)},
               {r(R2, 'r2_log', 4)}, {r('median(abs_err) * 100', 'mdape', 4)}, {r('median(err) * 100', 'median_bias_pct', 4)}
        FROM errors GROUP BY country HAVING count(*) >= {fv.MIN_COUNTRY_ROWS} ORDER BY n DESC, country"""

ORACLES |= {
    "country_report": f"WITH {PROJECTS} {PREPARED} {PREDICTIONS} {_COUNTRY_REPORT}",
    "country_report_top10": f"WITH {PROJECTS} {PREPARED} {PREDICTIONS} {_COUNTRY_REPORT} LIMIT 10",
    "subsystem_ratios": f"WITH {SUBSYSTEMS} {RATIOS} SELECT mode, is_global, n_projects, forced_global, low_n, {rs(SHARES)} FROM ratios",
    "subsystem_summary": f"WITH {SUBSYSTEMS} {RATIOS} SELECT mode, is_global, n_projects, ordinal, subsystem, {r('ratio', 'ratio')} FROM ratios_long",
    "mode_variability": f"""WITH {SUBSYSTEMS} {RATIOS}
        SELECT mode, is_global, {r('CASE WHEN avg(ratio) = 0 THEN 0.5 ELSE least(greatest(stddev_pop(ratio) / avg(ratio), 0), 1) END', 'variability')}
        FROM ratios_long GROUP BY mode, is_global""",
    "cost_breakdown": f"""WITH {SCORED}, {SUBSYSTEMS} {RATIOS} {SPLIT}
        SELECT request_id, transit_mode, ordinal, subsystem, {r('ratio', 'ratio')}, {r('pred * ratio', 'point')} FROM split""",
    "cost_breakdown_interval": f"""WITH {SCORED}, {SUBSYSTEMS} {RATIOS} {SPLIT} {PREDICTIONS} {BANDS}
        SELECT request_id, transit_mode, ordinal, subsystem, {r('ratio', 'ratio')}, {r('pred * ratio', 'point')},
               {r('pred * q10 * ratio', 'lo')}, {r('pred * q90 * ratio', 'hi')}, n_projects, fallback_used FROM split, bands""",
    "default_ratio_breakdown": f"""WITH {SCORED}, defaults AS ({DEFAULTS})
        SELECT request_id, subsystem, {r('ratio', 'ratio')}, {r('pred * ratio', 'point')},
               {r(f'pred * {fv.DEFAULT_Q10} * ratio', 'lo')}, {r(f'pred * {fv.DEFAULT_Q90} * ratio', 'hi')}, 0 AS n_projects
        FROM scored, defaults""",
    "breakdown_report": f"""WITH {SCORED}, {SUBSYSTEMS} {RATIOS} {SPLIT}
        SELECT request_id, ordinal, subsystem AS category, {r('pred * ratio / pred', 'ratio', 4)}, {r('pred * ratio', 'point', 4)},
               {r(REPORT_LO, 'lo', 4)}, {r(REPORT_HI, 'hi', 4)}, {r('pred * ratio * length_km', 'total_point', 4)},
               {r(f'{REPORT_LO} * length_km', 'total_lo', 4)}, {r(f'{REPORT_HI} * length_km', 'total_hi', 4)} FROM split""",
    "breakdown_report_text": f"""WITH {SCORED}, {SUBSYSTEMS} {RATIOS} {SPLIT}
        SELECT request_id, ordinal, subsystem AS category, {fixed('pred * ratio / pred * 100', 1)} || '%' AS share,
               {money('pred * ratio', 1)} AS point_per_km, {money(REPORT_LO, 1)} || ' – ' || {money(REPORT_HI, 1)} AS range_per_km,
               {money('pred * ratio * length_km', 0, 'M')} AS total_point_text,
               {money(f'{REPORT_LO} * length_km', 0, 'M')} || ' – ' || {money(f'{REPORT_HI} * length_km', 0, 'M')} AS total_range_text FROM split""",
    "valid_requests": f"""WITH {REQUESTS}
        SELECT request_id, start_year, end_year FROM requests WHERE end_year >= start_year""",
    "prediction_band": f"""WITH {SCORED} {PREDICTIONS} {BANDS}
        SELECT request_id, {r('pred', 'pred')}, {r('pred * q10', 'lo')}, {r('pred * q90', 'hi')},
               {r('pred * length_km / 1000', 'total_budget_billions')} FROM scored, bands WHERE end_year >= start_year""",
    "headline_text": f"""WITH {SCORED}
        SELECT request_id, {money('pred', 0, ' M')} AS cost_per_km,
               {money(f'pred * {fv.DEFAULT_Q10}', 0)} || ' – ' || {money(f'pred * {fv.DEFAULT_Q90}', 0, ' M')} AS band,
               '$' || {fixed('pred * length_km / 1000', 2)} || ' B' AS budget FROM scored""",
    "request_features": f"""WITH {SCORED}
        SELECT request_id, {rs(['country_te', 'country_freq', 'city_te', 'city_freq'], table='q.')},
               {r('CASE WHEN q.tunnel_pct > 1 THEN q.tunnel_pct / 100 ELSE q.tunnel_pct END', 'tunnel_pct')},
               {r('CASE WHEN q.num_stations > 0 THEN q.num_stations ELSE m.num_stations END / (q.length_km + 0.1)', 'station_density')},
               {r('CASE WHEN q.length_km > 0 THEN ln(q.length_km) END', 'log_length')},
               {r('CASE WHEN q.is_regional THEN 1.0 ELSE 0.0 END', 'is_regional_rail')},
               {r('(q.start_year + q.end_year) / 2', 'mid_year')} FROM looked_up q, medians m""",
    "similar_projects": f"""WITH {SIMILAR}
        SELECT request_id, rank, project_id, {r('score', 'score')}, same_place, match_percent, country, city, line,
               {rs(['start_year', 'end_year', 'length_km', 'tunnel_pct', 'num_stations', fv.TARGET])} FROM similar_found""",
    "similar_match_percent": f"""WITH {SIMILAR}, names AS ({NAMES})
        SELECT request_id, rank, match_percent || '%' AS match, coalesce(country_name, substr(country, 1, 2)) AS country_name, city, line,
               {fixed('length_km', 1)} AS length_text, round_even(tunnel_pct * 100, 0)::INTEGER || '%' AS tunnel_text,
               {money(fv.TARGET, 0, ' M')} AS cost_text, same_place
        FROM similar_found LEFT JOIN names ON code = substr(country, 1, 2)""",
    "driver_report_linear": f"""WITH {PROJECTS} {PREPARED},
        means AS (SELECT {", ".join(f"avg({f}) AS m_{f}" for f in LINEAR)} FROM prepared),
        parts AS ({" UNION ALL ".join(
            f"SELECT project_id, '{f}' AS feature, '{fv.FEATURES[f]}' AS factor, round(({f} - m_{f}) * {i + 1}, 9) AS raw_value FROM prepared, means"
            for i, f in enumerate(LINEAR))}),
        shares AS (SELECT *, abs(raw_value) AS impact_weight, sum(abs(raw_value)) OVER (PARTITION BY project_id) AS total FROM parts),
        kept AS (SELECT *, raw_value / nullif(total, 0) * 100 AS signed_percent FROM shares WHERE impact_weight / nullif(total, 0) > {fv.MIN_DRIVER_SHARE})
        SELECT project_id, feature, factor, {r('raw_value', 'raw_value')}, {r('impact_weight', 'impact_weight')},
               {r('signed_percent', 'signed_percent')},
               CASE WHEN raw_value > 0 THEN '{fv.DRIVER_UP}' ELSE '{fv.DRIVER_DOWN}' END AS direction,
               row_number() OVER (PARTITION BY project_id ORDER BY signed_percent, feature)::INTEGER AS position FROM kept""",
}


def _clean_subsystems() -> str:
    parsed = {c: dollars(c) for c in RAW_DOLLARS}
    base = ", ".join(f"({e}) AS {c}" for c, e in parsed.items())
    lengths = {"length_miles": "length_km", "tunnel_miles": "tunnel_km"}
    derived = {km: f"{mi} * {fv.KM_PER_MILE}" for mi, km in lengths.items()}
    derived |= {out: f"{c} / {fv.KM_PER_MILE}" for c, out in fv.PER_MILE_COSTS.items() if c in RAW_DOLLARS}
    derived |= {out: f"{c} / nullif(length_miles * {fv.KM_PER_MILE}, 0)" for c, out in fv.TOTALS_PER_KM.items() if c in RAW_DOLLARS}
    prices = [c for c in [*RAW_DOLLARS, *derived] if c not in lengths.values()]
    kept = ["length_miles", "tunnel_miles", *RAW_DOLLARS, "soft_costs_pct", "guideway_costs_pct"]
    return f"""WITH {RAW_SUBSYSTEMS}, {CPI},
        parsed AS (SELECT customer_id, project, mode, length_miles, tunnel_miles, {base}, soft_costs_pct, guideway_costs_pct FROM raw_subsystems),
        derived AS (SELECT *, {", ".join(f"{e} AS {c}" for c, e in derived.items())} FROM parsed)
        SELECT customer_id, project, mode, {rs(kept, 2)}, {rs(derived, 2)},
               {", ".join(r(f"{c} * {MULTIPLIER}", f"{c}_2023", 2) for c in prices)} FROM derived"""


ORACLES["clean_subsystems"] = _clean_subsystems()

ORACLES["similar_projects_unbroadcast"] = ORACLES["similar_projects"]

_GAPPED = PREDICTIONS.replace("c.te AS pred_log", "CASE WHEN project_id % 10 = 3 THEN NULL ELSE c.te END AS pred_log").replace(
    "FROM predictions)", "FROM predictions WHERE pred_log IS NOT NULL)"
)
for _name in ("metrics_by_fold", "country_report"):
    ORACLES[f"{_name}_with_gaps"] = ORACLES[_name].replace(PREDICTIONS, _GAPPED)

ORACLES["quantiles_narrowed"] = f"""WITH {PROJECTS} {PREPARED} {PREDICTIONS}
    SELECT country, {r('quantile_cont(err, 0.1)', 'err_10')}, {r('quantile_cont(err, 0.5)', 'err_50')},
           {r('quantile_cont(err, 0.9)', 'err_90')}, {r('quantile_cont(log_cost, 0.5)', 'cost_50')} FROM errors GROUP BY country"""
ORACLES["quantiles_narrowed_overall"] = f"""WITH {PROJECTS} {PREPARED} {PREDICTIONS}
    SELECT {r('quantile_cont(err, 0.1)', 'err_10')}, {r('quantile_cont(err, 0.5)', 'err_50')} FROM errors"""
ORACLES["lookup_salted"] = f"""WITH {REQUESTS} {PREPARED} {ENCODERS}
    SELECT request_id, country, {r('te', 'te')} FROM requests LEFT JOIN country_enc USING (country)"""

_HAND_SCORE = """(CASE WHEN tunnel_pct IS NOT NULL AND log_length IS NOT NULL AND is_regional_rail IS NOT NULL THEN
    4.5 + CASE WHEN tunnel_pct <= 0.3 THEN CASE WHEN log_length <= 3.0 THEN 0.2 ELSE -0.1 END ELSE 0.4 END
    + CASE WHEN is_regional_rail <= 0.5 THEN -0.3 ELSE 0.6 END END)::DOUBLE"""
ORACLES["leaf_table_score"] = f"WITH {PROJECTS} {PREPARED} SELECT project_id, {r(_HAND_SCORE, 'pred_log')} FROM prepared"
_T = "(tunnel_pct <= 0.3)::INTEGER"
_L = "(log_length <= 3.0)::INTEGER"
_R = "(is_regional_rail <= 0.5)::INTEGER"
ORACLES["leaf_table_shapley"] = f"""WITH {PROJECTS} {PREPARED}
    SELECT project_id,
           {r(f"(0.2 * ({_T} - 0.6) * ({_L} + 0.5) / 2 - 0.1 * ({_T} - 0.6) * (1 - {_L} + 0.5) / 2 + 0.4 * (1 - {_T} - 0.4))::DOUBLE", 'tunnel_pct')},
           {r(f"(0.2 * ({_L} - 0.5) * ({_T} + 0.6) / 2 - 0.1 * (1 - {_L} - 0.5) * ({_T} + 0.6) / 2)::DOUBLE", 'log_length')},
           {r(f"(-0.3 * ({_R} - 0.7) + 0.6 * (1 - {_R} - 0.3))::DOUBLE", 'is_regional_rail')}
    FROM prepared WHERE tunnel_pct IS NOT NULL AND log_length IS NOT NULL AND is_regional_rail IS NOT NULL"""

_BASE_COMPLETE = "tunnel_pct IS NOT NULL AND station_density IS NOT NULL AND log_length IS NOT NULL AND mid_year IS NOT NULL"
_OOF_MEDIAN = f"""{FOLDED},
fold_medians AS (
  SELECT h.fold, median(log_cost) AS m FROM folded x JOIN (SELECT unnest(range({fv.FOLDS}))::INTEGER AS fold) h ON x.fold <> h.fold
  WHERE {_BASE_COMPLETE} GROUP BY h.fold),
oof AS (
  SELECT project_id, f.fold, log_cost, CASE WHEN {_BASE_COMPLETE} THEN m END AS pred_log
  FROM folded f JOIN fold_medians g ON f.fold = g.fold)"""
ORACLES["oof_median_predictions"] = f"""WITH {PROJECTS} {PREPARED} {_OOF_MEDIAN}
    SELECT project_id, fold, {r('log_cost', 'log_cost')}, {r('pred_log', 'pred_log')} FROM oof"""
ORACLES["oof_median_report"] = f"""WITH {PROJECTS} {PREPARED} {_OOF_MEDIAN}
    SELECT fold, count(*) AS n, {r(R2, 'r2_log')}, {r('avg(abs(log_cost - pred_log))', 'mae_log')}
    FROM oof WHERE log_cost IS NOT NULL AND pred_log IS NOT NULL GROUP BY fold"""
ORACLES["quantile_boost_binary"] = f"""WITH {PROJECTS} {PREPARED},
start AS (SELECT median(log_cost) AS f0 FROM prepared WHERE log_cost IS NOT NULL),
own AS (SELECT is_regional_rail AS k, median(log_cost) AS m FROM prepared WHERE log_cost IS NOT NULL GROUP BY k)
    SELECT project_id, {r('m + (f0 - m) * 0.5 ^ 3', 'pred_log')} FROM prepared LEFT JOIN own ON k = is_regional_rail, start"""
_SIDE = "CASE j WHEN 0 THEN a <= 0 WHEN 1 THEN b <= 3 WHEN 2 THEN b <= 4 ELSE true END"


def _boost_round(i: int) -> str:
    """d{i + 1}: the rows of d{i} after a tree of one split, the first of the best ones, and half its leaf medians."""
    return f""",
s{i} AS (
  SELECT m, j, count(*) FILTER (l) AS nl, count(*) FILTER (NOT l) AS nr, sum(s) FILTER (l) AS sl, sum(s) FILTER (NOT l) AS sr
  FROM (SELECT m, j, CASE WHEN y > f THEN 0.5 ELSE -0.5 END::DOUBLE AS s, {_SIDE} AS l FROM d{i}, range(3) x(j) WHERE y IS NOT NULL AND trains)
  GROUP BY ALL),
g{i} AS (
  SELECT m, j FROM (SELECT m, j, round(nl * nr / (nl + nr) * (sl / nl - sr / nr) ^ 2, 9) AS gain FROM s{i} WHERE nl > 0 AND nr > 0)
  WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY m ORDER BY gain DESC, j) = 1),
d{i + 1} AS (
  SELECT m, project_id, a, b, y, trains, f + 0.5 * median(CASE WHEN trains THEN y - f END) OVER (PARTITION BY m, {_SIDE}) AS f
  FROM d{i} LEFT JOIN g{i} USING (m))"""


ORACLES["quantile_boost_two_features"] = f"""WITH {PROJECTS} {PREPARED},
d0 AS (
  SELECT m, project_id, is_regional_rail AS a, floor(least(greatest(log_length, 3), 5)) AS b, log_cost AS y,
         m = 1 OR project_id % 2 = 0 AS trains, median(CASE WHEN m = 1 OR project_id % 2 = 0 THEN log_cost END) OVER (PARTITION BY m) AS f
  FROM prepared, range(2) x(m) WHERE log_length IS NOT NULL){_boost_round(0)}{_boost_round(1)}
    SELECT project_id, {r('max(f) FILTER (m = 0)', 'pred_even')}, {r('max(f) FILTER (m = 1)', 'pred_all')} FROM d2 GROUP BY project_id"""
ORACLES["state_round_trip"] = f"""SELECT f.request_id, {r(_HAND_SCORE, 'pred_log')}, {r(f'exp({_HAND_SCORE})', 'pred')},
           {r(f'exp({_HAND_SCORE}) * q.length_km / 1000', 'total_budget_billions')}
    FROM ({ORACLES["request_features"]}) f JOIN (WITH {REQUESTS} SELECT request_id, length_km FROM requests) q USING (request_id)"""

ORACLES["state_after_broken_save"] = ORACLES["state_round_trip"]
ORACLES["clean_projects_from_csv"] = ORACLES["clean_projects"]
ORACLES["quality_row_drops_from_csv"] = ORACLES["quality_row_drops"]
ORACLES["requested_variability"] = f"""WITH {REQUESTS}, known AS ({ORACLES["mode_variability"]})
    SELECT request_id, transit_mode, coalesce(o.variability, g.variability) AS variability
    FROM requests q LEFT JOIN known o ON NOT o.is_global AND o.mode = q.transit_mode JOIN known g ON g.is_global"""

ORACLES["breakdown_hover_text"] = ORACLES["breakdown_report_text"].split("SELECT request_id, ordinal")[0] + f"""SELECT request_id, ordinal, subsystem AS category,
    {money(REPORT_LO, 1)} || ' – ' || {money(REPORT_HI, 1, ' M/km')} AS range_str FROM split"""
ORACLES["request_summary_text"] = f"""WITH {REQUESTS}, names AS ({NAMES})
    SELECT request_id, city || ', ' || coalesce(country_name, country) AS location,
           {fixed('length_km', 1)} || ' km / ' || round_even(tunnel_pct * 100, 0)::INTEGER || '% Tunnel' AS topology,
           num_stations::INTEGER || ' Units' AS stations, coalesce(transit_mode, '—') AS mode
    FROM requests LEFT JOIN names ON code = country"""
ORACLES["driver_report_text"] = f"""SELECT project_id, position, factor,
    CASE WHEN signed_percent >= 0 THEN '+' ELSE '' END || {fixed('signed_percent', 1)} || '%' AS percent_text, direction
    FROM ({ORACLES["driver_report_linear"].replace(r('signed_percent', 'signed_percent'), 'signed_percent')})"""
ORACLES["raw_records_checked"] = f"""WITH {RAW_PROJECTS},
checked AS (SELECT *, CASE WHEN project_id % 17 = 0 THEN 'too few cells' WHEN project_id % 19 = 0 THEN 'too many cells'
                    WHEN project_id % 23 = 0 THEN 'open quote' END AS reason FROM raw_projects)
SELECT project_id, CASE WHEN reason IS NULL THEN coalesce(city, 'N/A') || ', "old"' END AS city,
       CASE WHEN reason IS NULL THEN country END AS country,
       CASE reason WHEN 'too few cells' THEN 2 WHEN 'too many cells' THEN 14 END::INTEGER AS n_cells, reason FROM checked"""
