"""The catalog's queries as DuckDB SQL over the same tables.

Written from the definitions, not from the Spark plans: unions of three role
tables where Spark expands once, windows where Spark joins an aggregate back.
"""

from __future__ import annotations

from statistics import NormalDist

from crossfade.catalog import fixture as fx
from crossfade.operators.filters import EVENT_COLUMNS, FEATURE_EXCLUDED, MODEL_EXCLUDED, SCALING_EXCLUDED
from crossfade.sources.scan import PANEL_SCHEMA

# Columns of the panel and the events by their Spark type.
TYPES = {f.name: f.dataType.simpleString() for f in PANEL_SCHEMA.fields}
PANEL = list(TYPES)
BASE = PANEL[: PANEL.index("age") + 1]
NUMERIC = [c for c in PANEL if TYPES[c] != "string"]
EVENT_DOUBLES = {
    "yards_gained", "epa", "success", "air_yards", "yards_after_catch", "pass_attempt",
    "rush_attempt", "sack", "qb_hit",
}
KEYS = "gsis_id, season, position_group"
ORDINAL = "CASE position_group WHEN 'RB' THEN 1 WHEN 'WR_TE' THEN 2 ELSE 3 END"
BY_ENTITY = f"PARTITION BY gsis_id ORDER BY season, {ORDINAL}"


def r(expr: str, name: str) -> str:
    """A double, rounded as the queries are."""
    return f"round({expr}, 6) + 0.0 AS {name}"


def cols(names) -> str:
    """Panel columns, doubles rounded."""
    return ", ".join(r(n, n) if TYPES.get(n) == "double" else n for n in names)


def _ctes(variant: str) -> str:
    if variant == "flags":
        unit = "o_orderpriority"
        rush, target, passer = ("l_returnflag = 'R'", "l_returnflag = 'A'", "l_returnflag = 'N'")
    else:
        unit = "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'HI' ELSE 'LO' END"
        rush, target, passer = ("l_suppkey % 3 = 0", "l_suppkey % 3 = 1", "l_suppkey % 3 = 2")
    least = fx.MIN_VOLUME[variant]
    last = "arg_max(posteam, (game_id, play_id)) AS team"
    return f"""
WITH ev AS (
  SELECT strftime(l_shipdate, '%Y-%m-%d') AS game_id, l_orderkey AS play_id,
    CAST(year(l_shipdate) AS INTEGER) AS season,
    CASE WHEN l_linenumber = 7 THEN 'POST' ELSE 'REG' END AS season_type,
    {unit} AS home_team, o_orderstatus AS away_team, {unit} AS posteam,
    o_orderstatus AS defteam, CASE WHEN {rush} THEN 'run' ELSE 'pass' END AS play_type,
    CASE WHEN l_quantity <> 50 THEN l_quantity END AS yards_gained,
    CASE WHEN l_discount <> 0 THEN l_extendedprice * (1 - l_discount) / CAST({fx.EPA_SCALE} AS DOUBLE) END AS epa,
    CAST(l_discount > CAST(0.05 AS DOUBLE) AS DOUBLE) AS success,
    l_quantity * 0.5 AS air_yards, l_quantity * 0.25 AS yards_after_catch,
    CASE WHEN {passer} THEN CAST(l_suppkey AS VARCHAR) END AS passer_player_id,
    CASE WHEN {rush} THEN CAST(l_suppkey AS VARCHAR) END AS rusher_player_id,
    CASE WHEN {target} THEN CAST(l_suppkey AS VARCHAR) END AS receiver_player_id,
    CASE WHEN {rush} THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS pass_attempt,
    CASE WHEN {rush} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS rush_attempt,
    CAST(l_linestatus = 'F' AS DOUBLE) AS sack,
    CAST(l_tax > CAST(0.04 AS DOUBLE) AS DOUBLE) AS qb_hit
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), roster AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS gsis_id, CAST(y AS INTEGER) AS season,
    CAST(y - 1995 + s_nationkey % 6 AS INTEGER) AS years_exp,
    DATE '1955-01-01' + CAST(floor(s_acctbal) AS INTEGER) AS birth_date
  FROM supplier CROSS JOIN range(1995, 2002) AS seasons(y)
), aged AS (
  SELECT gsis_id, season, years_exp,
    date_diff('day', birth_date, make_date(season, 9, 1)) / CAST(365.25 AS DOUBLE) AS age
  FROM roster
), known AS (
  SELECT aged.* FROM aged JOIN supplier ON gsis_id = CAST(s_suppkey AS VARCHAR)
  WHERE s_nationkey <> 24 AND NOT (s_nationkey % 10 = 3 AND season = 1997)
), reg AS (
  SELECT * FROM ev WHERE season_type = 'REG' AND epa IS NOT NULL
), rb AS (
  SELECT rusher_player_id AS gsis_id, season, avg(yards_gained) AS metric_raw,
    count(*) AS volume, avg(success) AS success_rate, sum(epa) AS total_epa, {last},
    'RB' AS position_group
  FROM reg WHERE rush_attempt = 1 AND rusher_player_id IS NOT NULL
  GROUP BY 1, 2 HAVING count(*) >= {least[0]}
), wr AS (
  SELECT receiver_player_id AS gsis_id, season, sum(yards_gained) / count(*) AS metric_raw,
    count(*) AS volume, avg(success) AS success_rate, {last}, 'WR_TE' AS position_group
  FROM reg WHERE pass_attempt = 1 AND receiver_player_id IS NOT NULL
  GROUP BY 1, 2 HAVING count(*) >= {least[1]}
), qb AS (
  SELECT passer_player_id AS gsis_id, season, avg(epa) AS metric_raw, count(*) AS volume,
    avg(success) AS metric_secondary, {last}, 'QB' AS position_group
  FROM reg WHERE (pass_attempt = 1 OR rush_attempt = 1) AND passer_player_id IS NOT NULL
  GROUP BY 1, 2 HAVING count(*) >= {least[2]}
), stacked AS (
  SELECT * FROM rb UNION ALL BY NAME SELECT * FROM wr UNION ALL BY NAME SELECT * FROM qb
), cohort AS (
  SELECT *, avg(metric_raw) OVER w AS mean_season, stddev_samp(metric_raw) OVER w AS sd_season
  FROM stacked WINDOW w AS (PARTITION BY season, position_group)
), base AS (
  SELECT cohort.*, (metric_raw - mean_season) / nullif(sd_season, 0) AS z_score,
    known.years_exp, known.age
  FROM cohort LEFT JOIN known ON cohort.gsis_id = known.gsis_id AND cohort.season = known.season
), lagged AS (
  SELECT *, lag(team) OVER ({BY_ENTITY}) AS prev_team FROM base
), flagged AS (
  SELECT *, CAST(CASE WHEN prev_team IS NOT NULL AND team <> prev_team THEN 1 ELSE 0 END
    AS INTEGER) AS changed_team FROM lagged
), moves AS (
  SELECT *, CAST(sum(changed_team) OVER ({BY_ENTITY}
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS years_since_change
  FROM flagged
), firsts AS (
  SELECT gsis_id, season AS transition_season, team AS new_team FROM (
    SELECT *, row_number() OVER ({BY_ENTITY}) AS k FROM moves
    WHERE changed_team = 1 AND years_exp >= 3) WHERE k = 1
), timed AS (
  SELECT moves.*, transition_season, new_team, season - transition_season AS rel_time
  FROM moves JOIN firsts ON moves.gsis_id = firsts.gsis_id
), banded AS (
  SELECT *, CAST(CASE WHEN rel_time >= 0 THEN 1 ELSE 0 END AS INTEGER) AS post_transition,
    CASE WHEN rel_time < 0 THEN 'Pre' ELSE 'Post' END AS phase
  FROM timed WHERE rel_time >= -2 AND rel_time <= 2
), averages AS (
  SELECT team, season, position_group, avg(z_score) AS team_pos_avg FROM base GROUP BY ALL
), offense AS (
  SELECT posteam, season, avg(epa) FILTER (WHERE pass_attempt = 1) AS team_pass_epa_per_play,
    avg(epa) FILTER (WHERE rush_attempt = 1) AS team_rush_epa_per_play,
    avg(sack) FILTER (WHERE pass_attempt = 1) AS team_sack_rate
  FROM reg GROUP BY posteam, season
), trends AS (
  SELECT gsis_id, CASE WHEN count(DISTINCT rel_time) < 2 THEN CAST(0 AS DOUBLE)
    ELSE regr_slope(z_score, rel_time) END AS pre_trend_slope
  FROM banded WHERE rel_time < 0 GROUP BY gsis_id
), panel AS (
  SELECT banded.*, team_pos_avg,
    coalesce(CASE WHEN banded.position_group IN ('RB', 'WR_TE') THEN team_pass_epa_per_play
      WHEN banded.position_group = 'QB' THEN -team_sack_rate ELSE 0 END, 0) AS team_quality,
    team_pass_epa_per_play, team_rush_epa_per_play, team_sack_rate, pre_trend_slope
  FROM banded
  LEFT JOIN averages ON banded.team = averages.team AND banded.season = averages.season
    AND banded.position_group = averages.position_group
  LEFT JOIN offense ON banded.team = offense.posteam AND banded.season = offense.season
  LEFT JOIN trends ON banded.gsis_id = trends.gsis_id
), scored AS (
  SELECT gsis_id, season, position_group, position_group AS position, z_score AS actual,
    team_pos_avg AS predicted, z_score - team_pos_avg AS error,
    abs(z_score - team_pos_avg) AS abs_error FROM panel
)"""


def flags(sql: str, more: str = "") -> str:
    """A statement over the three-group variant; ``more`` adds CTEs."""
    return f"{_ctes('flags')}{', ' + more if more else ''}\n{sql}"


def single(sql: str, more: str = "") -> str:
    return f"{_ctes('single')}{', ' + more if more else ''}\n{sql}"


def _events(names, doubles=EVENT_DOUBLES) -> str:
    return ", ".join(r(n, n) if n in doubles else n for n in names)


def _stacked(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def _role(player: str, attempts: str) -> str:
    columns = _events(["game_id", "play_id", "season", player, "yards_gained", "epa"])
    return flags(f"SELECT {columns} FROM reg WHERE ({attempts}) AND {player} IS NOT NULL")


def _summary(keys, statistics) -> str:
    parts = list(keys)
    for c in NUMERIC:
        whole = TYPES[c] != "double"
        for s in statistics:
            name = f"{c}_{s}"
            if s == "mean":
                parts.append(r(f"avg({c})", name))
            elif s == "sum":
                parts.append(f"CAST(sum({c}) AS BIGINT) AS {name}" if whole else r(f"sum({c})", name))
            elif s == "std":
                parts.append(r(f"stddev_samp({c})", name))
            else:
                parts.append(f"count({c}) AS {name}")
    return flags(f"SELECT {', '.join(parts)} FROM panel GROUP BY {', '.join(keys)}")


def _quantile(column: str, p: float) -> str:
    return f"quantile_cont(CAST({column} AS DOUBLE), {p})"


def _fences(names, width: float, table: str = "panel") -> str:
    """CTE body: one row per column."""
    return _stacked(
        f"SELECT '{c}' AS column_name, q1, q3, q1 - {width} * (q3 - q1) AS lower_fence, "
        f"q3 + {width} * (q3 - q1) AS upper_fence FROM (SELECT {_quantile(c, 0.25)} AS q1, "
        f"{_quantile(c, 0.75)} AS q3 FROM {table})"
        for c in names
    )


def _bound(column: str, side: str) -> str:
    return f"(SELECT {side}_fence FROM fences WHERE column_name = '{column}')"


def _capped(column: str) -> str:
    low, high = _bound(column, "lower"), _bound(column, "upper")
    value = f"CAST({column} AS DOUBLE)"
    return f"CASE WHEN {value} < {low} THEN {low} WHEN {value} > {high} THEN {high} ELSE {value} END"


def _clipped(column: str) -> str:
    return r(_capped(column), column)


def _cut(column: str, edges, labels, lower=None) -> str:
    ladder = f"WHEN {column} IS NULL THEN NULL "
    if lower is not None:
        ladder += f"WHEN {column} <= {lower} THEN NULL "
    for edge, label in zip(edges, labels):
        ladder += f"WHEN {column} <= {edge} THEN '{label}' "
    return f"CASE {ladder}ELSE '{labels[-1]}' END"


CAREER = ((3, 7, 12), ("Early", "Prime", "Veteran", "Late Career"))
EXPERIENCE = ((3, 7, 12), ("Rookie", "Early Career", "Prime", "Veteran"))
LEVEL = _cut("z_score", (-1, 0, 1), ("Below Avg", "Average", "Above Avg", "Elite"))
TREND = _cut("pre_trend_slope", (-0.05, 0.05), ("Declining", "Stable", "Improving"))
ADJUSTMENT = (
    "CASE WHEN years_since_change <= 1 THEN 'Transition' WHEN years_since_change <= 3 "
    "THEN 'Adjustment' ELSE 'Established' END"
)
CONTRACT = (
    "CAST(coalesce((position_group = 'RB' AND years_exp IN (6, 7, 8)) OR "
    "(position_group = 'QB' AND years_exp IN (7, 8, 9)), false) AS INTEGER)"
)
MEDIAN_COLUMNS = CLIPPED = SCALED = fx.MEASURES
STRINGS = [c for c in PANEL if TYPES[c] == "string"]
REPEATING = f"SELECT {cols(PANEL)} FROM panel UNION ALL SELECT {cols(PANEL)} FROM panel WHERE rel_time = 0"


def _split(before: int, upto: int) -> str:
    return (
        f"CASE WHEN rel_time < {before} THEN 'train' WHEN rel_time <= {upto} "
        "THEN 'validation' ELSE 'test' END"
    )


def _rolling(function: str, width: int) -> str:
    return f"{function}(z_score) OVER ({BY_ENTITY} ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW)"


def _median(column: str) -> str:
    return _quantile(column, 0.5)


def _encoded(column: str, smoothing: int) -> str:
    """Correlated-free target mean: windows over the panel."""
    total = f"coalesce(sum(z_score) OVER (PARTITION BY {column}), 0)"
    n = f"count(z_score) OVER (PARTITION BY {column})"
    overall = "avg(z_score) OVER ()"
    return (
        f"CASE WHEN {column} IS NULL OR {n} = 0 THEN {overall} ELSE "
        f"({total} + {smoothing} * {overall}) / ({n} + {smoothing}) END"
    )


MOMENTUM = f"z_score - lag(z_score) OVER ({BY_ENTITY})"
STEPPED = f"stepped AS (SELECT *, {MOMENTUM} AS m FROM panel)"
FIRST_VALUE = f"first_value(z_score) OVER ({BY_ENTITY})"


def _share(*keys: str) -> str:
    text = " || '|' || ".join(["'42'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) * CAST(100 AS DOUBLE) / 4294967296"


def _post(group: str) -> str:
    return f"CAST(position_group = '{group}' AS INTEGER) * post_transition AS \"{group}_post\""


def _components(columns: list[str], k: int, sweeps: int = 10) -> str:
    """CTEs of the components of standardised ``columns``, by cyclic Jacobi rotations.

    ``unit`` has the standardised rows, ``loading`` a row per component with
    its number, share of variance and loadings, the largest one positive.
    """
    n = len(columns)
    pairs = [(p, q) for p in range(1, n + 1) for q in range(p + 1, n + 1)]
    filled = ", ".join(
        f"coalesce(CAST({c} AS DOUBLE), (SELECT {_median(c)} FROM enriched)) AS f{i}" for i, c in enumerate(columns)
    )
    unit = ", ".join(
        f"(f{i} - avg(f{i}) OVER ()) / coalesce(nullif(stddev_pop(f{i}) OVER (), 0), 1)" for i in range(n)
    )
    products = ", ".join(
        "[" + ", ".join(f"sum(x[{i}] * x[{j}])" for j in range(1, n + 1)) + "]" for i in range(1, n + 1)
    )
    turned = "[[CASE j WHEN p THEN c * row[p] - s * row[q] WHEN q THEN s * row[p] + c * row[q] ELSE row[j] END FOR j IN range(1, {0})] FOR row IN {1}]"
    return f"""
enriched AS (SELECT *, metric_raw / (sd_season + 1e-10) AS metric_raw_scaled, age * age AS age_squared FROM panel),
filled AS (SELECT {KEYS}, {filled} FROM enriched),
unit AS (SELECT {KEYS}, [{unit}] AS x FROM filled),
jacobi(step, a, v) AS (
  SELECT 0, [{products}], [[CASE WHEN i = j THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END FOR j IN range({n})] FOR i IN range({n})] FROM unit
  UNION ALL
  SELECT step + 1,
    [[CASE i WHEN p THEN c * b[p][j] - s * b[q][j] WHEN q THEN s * b[p][j] + c * b[q][j] ELSE b[i][j] END FOR j IN range(1, {n + 1})] FOR i IN range(1, {n + 1})],
    {turned.format(n + 1, "v")}
  FROM (
    SELECT *, {turned.format(n + 1, "a")} AS b FROM (
      SELECT *, 1 / sqrt(1 + t * t) AS c, t / sqrt(1 + t * t) AS s FROM (
        SELECT *, CASE WHEN a[p][q] = 0 THEN CAST(0 AS DOUBLE) ELSE
            (CASE WHEN tau < 0 THEN -1 ELSE 1 END) / (abs(tau) + sqrt(1 + tau * tau)) END AS t FROM (
          SELECT *, CASE WHEN a[p][q] = 0 THEN CAST(0 AS DOUBLE) ELSE (a[q][q] - a[p][p]) / (2 * a[p][q]) END AS tau FROM (
            SELECT *, {[p for p, _ in pairs]}[step % {len(pairs)} + 1] AS p, {[q for _, q in pairs]}[step % {len(pairs)} + 1] AS q
            FROM jacobi WHERE step < {sweeps * len(pairs)})))))
), found AS (
  SELECT i, a[i][i] AS value, [row[i] FOR row IN v] AS w, list_sum([a[j][j] FOR j IN range(1, {n + 1})]) AS total
  FROM (SELECT * FROM jacobi WHERE step = {sweeps * len(pairs)}), range(1, {n + 1}) t(i)
), loading AS (
  SELECT row_number() OVER (ORDER BY value DESC) AS k, value / total AS share,
    [e * (CASE WHEN w[list_position([abs(u) FOR u IN w], list_max([abs(u) FOR u IN w]))] < 0 THEN -1 ELSE 1 END) FOR e IN w] AS w
  FROM found QUALIFY k <= {k}
)"""


def _loess(single) -> str:
    """Local quadratics at the few relative times, on the panel's rows."""
    unit = "(CAST(x AS DOUBLE) - v) / h"
    weight = "CASE WHEN h = 0 THEN CAST(x = v AS INTEGER) WHEN abs(x - v) < h THEN pow(1 - pow(abs(CAST(x AS DOUBLE) - v) / h, 3), 3) ELSE 0 END"
    sums = ", ".join(
        [f"sum(w * pow(z, {k})) AS s{k}" for k in range(5)] + [f"sum(w * y * pow(z, {k})) AS t{k}" for k in range(3)] + [f"sum(w * w * pow(z, {k})) AS q{k}" for k in range(5)]
    )
    # the first row of the inverse; a fit with fewer than three x in reach is the mean at the point
    det = "(s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2))"
    row = f"[(s2 * s4 - s3 * s3) / {det}, (s2 * s3 - s1 * s4) / {det}, (s1 * s3 - s2 * s2) / {det}]"
    variance = " + ".join(f"c[{i + 1}] * c[{j + 1}] * q{i + j}" for i in range(3) for j in range(3))
    density = "exp(ls - (df + 1) / 2 * ln(1 + {0} * {0} / df))".format
    at = "(exp(ln(1 + t) * i / 2000) - 1)"
    area = f"list_sum([(CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {density(at)} * exp(ln(1 + t) * i / 2000) FOR i IN range(0, 2001)]) * ln(1 + t) / 6000"
    return single(
        f"SELECT position_group, v AS rel_time, n, {r('fit', 'fit')}, {r('se', 'se')}, {r('df', 'df')}, {r('fit - t * se', 'low')}, {r('fit + t * se', 'high')} "
        "FROM (SELECT *, CASE WHEN df > 1e-6 THEN sqrt(rss / df * factor) END AS se FROM fits JOIN stats USING (position_group)) LEFT JOIN quantile USING (position_group)",
        "obs AS (SELECT position_group, rel_time AS x, z_score AS y, count(*) OVER (PARTITION BY position_group) AS n FROM panel WHERE z_score IS NOT NULL AND rel_time IS NOT NULL), "
        "spots AS (SELECT DISTINCT position_group, CAST(x AS DOUBLE) AS v FROM obs), "
        "widths AS (SELECT position_group, v, list_sort(list(abs(x - v)))[greatest(CAST(floor(any_value(n) * CAST(0.75 AS DOUBLE) + 1e-5) AS BIGINT), 1)] AS h FROM obs JOIN spots USING (position_group) GROUP BY 1, 2), "
        f"weighed AS (SELECT *, {weight} AS w, CASE WHEN h = 0 THEN 0 ELSE {unit} END AS z FROM obs JOIN widths USING (position_group)), "
        f"moments AS (SELECT position_group, v, any_value(n) AS n, count(DISTINCT x) AS reach, avg(y) FILTER (WHERE x = v) AS here, count(*) FILTER (WHERE x = v) AS rows_here, {sums} FROM weighed WHERE w > 0 GROUP BY 1, 2), "
        f"solved AS (SELECT *, {row} AS c FROM moments), "
        f"fits AS (SELECT *, CASE WHEN reach < 3 THEN here ELSE c[1] * t0 + c[2] * t1 + c[3] * t2 END AS fit, "
        f"CASE WHEN reach < 3 THEN 1 / rows_here ELSE {variance} END AS factor, CASE WHEN reach < 3 THEN 1 / rows_here ELSE c[1] END AS own FROM solved), "
        "stats AS (SELECT position_group, sum(pow(y - fit, 2)) AS rss, count(*) - sum(own) AS df FROM obs JOIN (SELECT position_group, v, fit, own FROM fits) USING (position_group) WHERE x = v GROUP BY 1), "
        f"steps(position_group, df, ls, t, k) AS (SELECT position_group, df, lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * ln(df * pi()), CAST({NormalDist().inv_cdf(0.975)!r} AS DOUBLE), 0 FROM stats WHERE df > 1e-6 "
        f"UNION ALL SELECT position_group, df, ls, t + (0.475 - {area}) / {density('t')}, k + 1 FROM steps WHERE k < 12), "
        "quantile AS (SELECT position_group, t FROM steps WHERE k = 12)",
    ).replace("WITH ev AS", "WITH RECURSIVE ev AS", 1)


def oracles() -> dict[str, str]:
    o: dict[str, str] = {}

    # -- sources and sinks
    o["scan_events"] = flags(
        f"SELECT {_events([*EVENT_COLUMNS, 'season_type'])} FROM ev WHERE season <> 1998"
    )
    o["scan_roster"] = flags("SELECT * FROM roster")
    whole = flags(f"SELECT {cols(PANEL)} FROM panel")
    for name in ("scan_panel_csv", "scan_panel_parquet", "transition_panel"):
        o[name] = whole
    o["roundtrip_intermediate"] = flags(f"SELECT {cols(BASE)} FROM base")
    enriched = (
        f"{cols(PANEL)}, {r('metric_raw / (sd_season + 1e-10)', 'metric_raw_scaled')}, "
        f"{LEVEL} AS performance_level, {_cut('years_exp', *CAREER, lower=0)} AS career_phase, "
        f"{r('age * age', 'age_squared')}"
    )
    o["sink_csv"] = flags(f"SELECT {enriched} FROM panel")
    o["sink_parquet"] = flags(f"SELECT {cols(PANEL)} FROM panel")
    o["sink_by_split"] = flags(f"SELECT {cols(PANEL)}, {_split(-2, 0)} AS data_split FROM panel")
    missing = ", ".join(f"count(*) - count({c}) AS missing_{c}" for c in PANEL)
    o["quality_report"] = flags(
        f"SELECT count(*) AS total_rows, CAST({len(PANEL)} AS INTEGER) AS total_columns, "
        f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM panel)) AS duplicate_rows, "
        f"{missing} FROM panel"
    )

    # -- filters and projections
    o["filter_regular"] = flags(f"SELECT {_events(EVENT_COLUMNS)} FROM reg")
    o["filter_role_rush"] = _role("rusher_player_id", "rush_attempt = 1")
    o["filter_role_target"] = _role("receiver_player_id", "pass_attempt = 1")
    o["filter_role_pass_or_rush"] = _role("passer_player_id", "pass_attempt = 1 OR rush_attempt = 1")
    volumes = "FROM reg WHERE rush_attempt = 1 AND rusher_player_id IS NOT NULL GROUP BY ALL HAVING count(*) >= 16"
    o["having_min_volume"] = flags(
        f"SELECT rusher_player_id, season, count(*) AS volume {volumes}"
    )
    o["project_literal_rename"] = flags(
        "SELECT rusher_player_id AS gsis_id, season, count(*) AS volume, "
        f"'RB' AS position_group {volumes}"
    )
    o["filter_window_band"] = flags(f"SELECT {KEYS}, transition_season, rel_time FROM banded")
    o["filter_veteran_moves"] = flags(
        "SELECT gsis_id, season AS transition_season, team AS new_team FROM moves "
        "WHERE changed_team = 1 AND years_exp >= 3"
    )
    o["filter_split_isin"] = flags(
        f"SELECT {KEYS}, rel_time, {_split(-2, 0)} AS data_split FROM panel WHERE rel_time >= -2"
    )
    o["select_numeric_features"] = flags(
        f"SELECT {cols(c for c in NUMERIC if c not in (*MODEL_EXCLUDED, 'z_score'))} FROM panel"
    )
    o["transition_events"] = flags(
        f"SELECT {KEYS}, prev_team, new_team, {cols(['metric_raw', 'z_score'])} FROM panel "
        "WHERE changed_team = 1"
    )
    o["schema_profile"] = flags(
        _stacked(
            f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column_name, '{TYPES[c]}' AS data_type, "
            f"count(*) AS n_rows, count({c}) AS n_values FROM panel"
            for i, c in enumerate(PANEL)
        )
    )
    o["type_counts"] = flags(
        "SELECT data_type, count(*) AS n_columns FROM ("
        + _stacked(f"SELECT '{TYPES[c]}' AS data_type, max({c}) IS NULL AS n FROM panel" for c in PANEL)
        + ") GROUP BY data_type"
    )
    o["sample_head"] = flags(
        f"SELECT {cols(PANEL)} FROM (SELECT * FROM panel ORDER BY gsis_id, season, {ORDINAL} LIMIT 5)"
    )

    # -- joins
    o["join_roster_left"] = flags(f"SELECT {cols(BASE)} FROM base")
    o["join_first_transition"] = single(
        f"SELECT {KEYS}, team, transition_season, new_team FROM timed"
    )
    o["join_team_pos_avg"] = flags(
        f"SELECT {KEYS}, team, "
        f"{r('avg(z_score) OVER (PARTITION BY team, season, position_group)', 'team_pos_avg')} FROM base"
    )
    offense = ["team_pass_epa_per_play", "team_rush_epa_per_play", "team_sack_rate"]
    o["join_team_offense"] = flags(
        f"SELECT gsis_id, base.season, position_group, team, {cols(offense)} FROM base "
        "LEFT JOIN offense ON base.team = offense.posteam AND base.season = offense.season"
    )
    o["join_pre_trend"] = flags(f"SELECT {KEYS}, rel_time, {cols(['pre_trend_slope'])} FROM panel")
    o["join_back_aggregate"] = flags(
        f"SELECT {KEYS}, panel.team, {r('coalesce(team_mean, 0)', 'team_mean')} FROM panel "
        "LEFT JOIN kept ON panel.team = kept.team",
        "seasonal AS (SELECT team, season, avg(z_score) AS m FROM panel WHERE rel_time < -1 "
        "GROUP BY team, season), kept AS (SELECT team, avg(m) AS team_mean FROM seasonal "
        "GROUP BY team HAVING avg(m) > 0)",
    )
    late = "(SELECT gsis_id FROM firsts WHERE transition_season >= 1998)"
    kept = f"SELECT {KEYS}, {cols(['z_score'])} FROM base WHERE gsis_id"
    o["semi_holdout_entities"] = single(f"{kept} IN {late}")
    o["anti_holdout_entities"] = single(f"{kept} NOT IN {late}")

    # -- aggregates
    o["rush_efficiency"] = flags(f"SELECT {cols([*BASE[:8]])} FROM rb")
    o["target_efficiency"] = flags(
        f"SELECT {cols(c for c in BASE[:8] if c != 'total_epa')} FROM wr"
    )
    o["passer_efficiency"] = flags(
        f"SELECT {cols(c for c in BASE[:9] if c not in ('success_rate', 'total_epa'))} FROM qb"
    )
    o["role_metrics"] = o["union_positions"] = flags(f"SELECT {cols(BASE[:9])} FROM stacked")
    o["last_team"] = flags(
        "SELECT coalesce(rusher_player_id, receiver_player_id, passer_player_id) AS gsis_id, "
        "season, arg_max(posteam, (game_id, play_id)) AS team FROM reg GROUP BY 1, 2"
    )
    o["team_position_avg"] = flags(
        f"SELECT team, season, position_group, {cols(['team_pos_avg'])} FROM averages"
    )
    o["team_offense_context"] = flags(f"SELECT posteam, season, {cols(offense)} FROM offense")
    o["pre_trend_slope"] = single(f"SELECT gsis_id, {cols(['pre_trend_slope'])} FROM trends")
    o["entity_season_summary"] = _summary(["gsis_id", "season"], ("mean", "sum", "std", "count"))
    o["team_season_summary"] = _summary(["team", "season"], ("mean", "sum", "std"))
    o["value_counts"] = flags(
        _stacked(
            f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n "
            f"FROM panel WHERE {c} IS NOT NULL GROUP BY {c}"
            for c in fx.CATEGORIES
        )
    )
    o["distinct_counts"] = flags(
        _stacked(
            f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct FROM panel"
            for c in PANEL
        )
    )
    o["describe_numeric"] = flags(
        _stacked(
            f"SELECT '{c}' AS column_name, count({c}) AS n, {r(f'avg({c})', 'mean')}, "
            f"{r(f'stddev_samp({c})', 'std')}, {r(f'CAST(min({c}) AS DOUBLE)', 'min')}, "
            f"{r(f'CAST(max({c}) AS DOUBLE)', 'max')}, {r(_quantile(c, 0.25), 'q25')}, "
            f"{r(_quantile(c, 0.5), 'q50')}, {r(_quantile(c, 0.75), 'q75')} FROM panel"
            for c in NUMERIC
        )
    )
    gaps = _stacked(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count, "
        f"round((count(*) - count({c})) * 100 / CAST(count(*) AS DOUBLE), 2) + 0.0 AS missing_pct "
        "FROM panel"
        for c in PANEL
    )
    o["missing_profile"] = flags(f"SELECT * FROM ({gaps}) WHERE missing_count > 0")
    o["duplicate_count"] = flags(
        f"SELECT (SELECT count(*) FROM ({REPEATING})) - "
        f"(SELECT count(*) FROM (SELECT DISTINCT * FROM ({REPEATING}))) AS n_duplicates"
    )
    incomplete = " OR ".join(f"{c} IS NULL" for c in PANEL)
    o["rows_with_nulls"] = flags(
        f"SELECT count(*) AS n_rows_with_nulls FROM panel WHERE {incomplete}"
    )
    known = " + ".join(f"count({c})" for c in PANEL)
    completeness = f"100 * ({known}) / CAST(count(*) * {len(PANEL)} AS DOUBLE)"
    o["completeness"] = flags(
        f"SELECT count(*) AS n_rows, count(*) FILTER (WHERE NOT ({incomplete})) AS complete_rows, "
        f"{r(completeness, 'completeness_pct')} FROM panel"
    )
    o["season_range"] = flags(
        "SELECT min(season) AS first_season, max(season) AS last_season, "
        "count(DISTINCT season) AS n_seasons FROM panel"
    )
    fence_columns = ", ".join(r(c, c) for c in ("q1", "q3", "lower_fence", "upper_fence"))
    o["quartile_fences"] = flags(
        f"SELECT column_name, {fence_columns} FROM ({_fences(NUMERIC, 3)})"
    )
    middle = ", ".join(r(_median(c), c) for c in MEDIAN_COLUMNS)
    o["group_median"] = flags(f"SELECT position_group, {middle} FROM panel GROUP BY position_group")
    o["global_median"] = flags(f"SELECT {middle} FROM panel")
    modes = _stacked(
        f"SELECT '{c}' AS column_name, {c} AS mode, count(*) AS n, "
        f"row_number() OVER (ORDER BY count(*) DESC, {c}) AS k FROM panel "
        f"WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in STRINGS
    )
    o["column_mode"] = flags(f"SELECT column_name, mode, n FROM ({modes}) WHERE k = 1")
    change = (
        "change AS (SELECT gsis_id, position_group, pre_trend_slope, "
        "avg(z_score) FILTER (WHERE rel_time < 0) AS pre_mean, "
        "avg(z_score) FILTER (WHERE rel_time >= 0) AS post_mean FROM panel GROUP BY 1, 2, 3)"
    )
    o["pre_post_change"] = single(
        f"SELECT gsis_id, position_group, {cols(['pre_trend_slope'])}, {r('pre_mean', 'pre_mean')}, "
        f"{r('post_mean', 'post_mean')}, {r('post_mean - pre_mean', 'post_change')} FROM change",
        change,
    )
    outside = _stacked(
        f"SELECT '{c}' AS column_name, count(*) AS n_outliers FROM panel WHERE {c} < "
        f"{_bound(c, 'lower')} OR {c} > {_bound(c, 'upper')}"
        for c in NUMERIC
    )
    o["capped_outlier_counts"] = flags(
        f"SELECT * FROM ({outside}) WHERE n_outliers > 0 ORDER BY n_outliers DESC, column_name LIMIT 5",
        f"fences AS ({_fences(NUMERIC, 3)})",
    )
    o["error_summary"] = flags(
        f"SELECT {r('avg(error)', 'mean_error')}, {r('avg(abs(error))', 'mean_abs_error')}, "
        f"{r('stddev_samp(error)', 'std_error')} FROM scored"
    )
    o["regression_metrics"] = flags(
        "SELECT "
        + r("1 - sum(error * error) / sum((actual - mean) * (actual - mean))", "r2")
        + f", {r('sqrt(avg(error * error))', 'rmse')}, {r('avg(abs(error))', 'mae')} "
        "FROM (SELECT *, avg(actual) OVER () AS mean FROM scored)"
    )
    o["transition_summary"] = flags(
        "SELECT 'all' AS scope, count(*) AS n_events, count(DISTINCT gsis_id) AS n_entities "
        "FROM panel WHERE changed_team = 1 UNION ALL SELECT position_group, count(*), "
        "CAST(NULL AS BIGINT) FROM panel WHERE changed_team = 1 GROUP BY position_group"
    )

    # -- windows
    o["zscore_by_season_group"] = flags(
        f"SELECT {KEYS}, {cols(['metric_raw', 'mean_season', 'sd_season', 'z_score'])} FROM base"
    )
    o["prev_team"] = flags(f"SELECT {KEYS}, team, prev_team FROM moves")
    o["team_change_flag"] = flags(f"SELECT {KEYS}, changed_team FROM moves")
    o["cumulative_moves"] = flags(f"SELECT {KEYS}, changed_team, years_since_change FROM moves")
    o["first_transition"] = flags("SELECT * FROM firsts")
    o["rolling_mean"] = flags(
        f"SELECT {KEYS}, {r(_rolling('avg', 2), 'z_score_roll2')}, "
        f"{r(_rolling('avg', 3), 'z_score_roll3')} FROM panel"
    )
    o["rolling_volatility"] = flags(
        f"SELECT {KEYS}, {r(_rolling('stddev_samp', 2), 'z_score_vol2')}, "
        f"{r(_rolling('stddev_samp', 3), 'z_score_vol3')} FROM panel"
    )
    o["momentum"] = flags(f"SELECT {KEYS}, {r('m', 'z_score_momentum')} FROM stepped", STEPPED)
    o["acceleration"] = flags(
        f"SELECT {KEYS}, {r(f'm - lag(m) OVER ({BY_ENTITY})', 'z_score_acceleration')} FROM stepped",
        STEPPED,
    )
    o["cumulative_change"] = flags(
        f"SELECT {KEYS}, {r(f'z_score - {FIRST_VALUE}', 'z_score_cumulative_change')} FROM panel"
    )
    spread = "stddev_samp(z_score) OVER (PARTITION BY gsis_id)"
    o["entity_volatility"] = flags(f"SELECT {KEYS}, {r(spread, 'performance_variance')} FROM panel")
    imputed = ", ".join(
        r(f"coalesce(panel.{c}, middle.{c})", c) for c in MEDIAN_COLUMNS
    )
    o["impute_group_median"] = flags(
        f"SELECT panel.gsis_id, panel.season, panel.position_group, {imputed} FROM panel "
        "JOIN middle ON panel.position_group = middle.position_group",
        "middle AS (SELECT position_group, "
        + ", ".join(f"{_median(c)} AS {c}" for c in MEDIAN_COLUMNS)
        + " FROM panel GROUP BY position_group)",
    )

    # -- order and shape
    o["sort_entity_season"] = flags(
        f"SELECT {KEYS}, rel_time, {cols(['z_score'])} FROM panel ORDER BY gsis_id, season, {ORDINAL}"
    )
    o["distinct_pairs"] = single(
        f"SELECT gsis_id, {cols(['pre_trend_slope'])} FROM (SELECT DISTINCT gsis_id, pre_trend_slope FROM panel)"
    )
    o["drop_duplicates"] = flags(f"SELECT DISTINCT * FROM ({REPEATING})")
    o["append_dummy_columns"] = flags(
        f"SELECT {KEYS}, team, CAST(team = '1-URGENT' AS INTEGER) AS \"unit_1-URGENT\", "
        "CAST(team = '2-HIGH' AS INTEGER) AS \"unit_2-HIGH\" FROM panel"
    )
    o["distinct_entities"] = flags("SELECT DISTINCT gsis_id FROM panel")

    # -- scalar functions
    o["age_on_season_start"] = flags(
        f"SELECT gsis_id, season, years_exp, {cols(['age'])} FROM aged"
    )
    o["relative_time"] = flags(f"SELECT {KEYS}, season - transition_season AS rel FROM panel")
    o["phase_label"] = flags(
        f"SELECT {KEYS}, CAST(rel_time >= 0 AS INTEGER) AS post, "
        "CASE WHEN rel_time < 0 THEN 'Pre' ELSE 'Post' END AS label FROM panel"
    )
    o["team_quality"] = flags(f"SELECT {KEYS}, {r('team_quality', 'quality')} FROM panel")
    o["scaled_metric"] = flags(
        f"SELECT {KEYS}, {r('metric_raw / (sd_season + 1e-10)', 'metric_raw_scaled')} FROM panel"
    )
    o["performance_level"] = flags(f"SELECT {KEYS}, {LEVEL} AS performance_level FROM panel")
    o["career_phase"] = flags(
        f"SELECT {KEYS}, {_cut('years_exp', *CAREER, lower=0)} AS career_phase FROM base"
    )
    o["exp_group"] = flags(
        f"SELECT {KEYS}, {_cut('years_exp', *EXPERIENCE, lower=0)} AS exp_group FROM base"
    )
    o["pre_trend_category"] = flags(f"SELECT {KEYS}, {TREND} AS pre_trend_category FROM panel")
    o["adjustment_phase"] = flags(f"SELECT {KEYS}, {ADJUSTMENT} AS adjustment_phase FROM panel")
    o["clip_outliers"] = flags(
        f"SELECT {KEYS}, {', '.join(_clipped(c) for c in CLIPPED)} FROM panel",
        f"fences AS ({_fences(CLIPPED, 0.5)})",
    )
    filled_age = f"coalesce(age, (SELECT {_median('age')} FROM base))"
    o["polynomial_terms"] = flags(
        f"SELECT {KEYS}, {r('filled * filled', 'age_squared')}, "
        f"{r('filled * filled * filled', 'age_cubed')}, years_exp * years_exp AS exp_squared "
        f"FROM (SELECT *, {filled_age} AS filled FROM base)"
    )
    o["exp_decay"] = flags(f"SELECT {KEYS}, {r('exp(-0.1 * age)', 'age_exp_decay')} FROM panel")
    o["peak_distance"] = flags(f"SELECT {KEYS}, years_exp - 5 AS peak_years_away FROM panel")
    o["contract_year_flag"] = flags(f"SELECT {KEYS}, {CONTRACT} AS likely_contract_year FROM base")
    o["interaction_terms"] = flags(
        f"SELECT {KEYS}, {r('age * post_transition', 'age_post_interaction')}, "
        "years_exp * post_transition AS exp_post_interaction, "
        f"{r('team_quality * z_score', 'quality_performance_interaction')} FROM panel"
    )
    posts = ", ".join(_post(g) for g in ("QB", "RB", "WR_TE"))
    o["position_post_indicators"] = flags(f"SELECT {KEYS}, {posts} FROM panel")
    o["split_label"] = flags(f"SELECT {KEYS}, rel_time, {_split(-1, 0)} AS data_split FROM panel")
    o["trajectory_copy"] = flags(
        f"SELECT {KEYS}, {r('pre_trend_slope', 'performance_trajectory')}, "
        f"{r(spread, 'performance_variance')}, {CONTRACT} AS likely_contract_year FROM panel"
    )
    zeros = ", ".join(r(f"CAST(coalesce({c}, 0) AS DOUBLE)", c) for c in fx.MEASURES)
    o["fill_zero"] = flags(f"SELECT {KEYS}, {zeros} FROM panel")
    o["impute_mode"] = flags(
        f"SELECT {KEYS}, coalesce(team, (SELECT team FROM moves WHERE team IS NOT NULL GROUP BY team "
        "ORDER BY count(*) DESC, team LIMIT 1)) AS team, coalesce(prev_team, (SELECT prev_team FROM moves WHERE prev_team "
        "IS NOT NULL GROUP BY prev_team ORDER BY count(*) DESC, prev_team LIMIT 1)) AS prev_team "
        "FROM moves"
    )
    o["residual_columns"] = flags(
        f"SELECT {KEYS}, position, "
        + ", ".join(r(c, c) for c in ("actual", "predicted", "error", "abs_error"))
        + " FROM scored"
    )

    # -- encoding, scaling, splitting
    full = "filled AS (SELECT gsis_id, season, position_group, " + ", ".join(
        f"coalesce({c}, (SELECT {_median(c)} FROM panel)) AS {c}" for c in SCALED
    ) + " FROM panel)"
    scaled = ", ".join(
        r(f"({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1)", c)
        for c in SCALED
    )
    o["standardize"] = flags(f"SELECT {KEYS}, {scaled} FROM filled", full)
    teams = ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    dummies = ", ".join(
        [f"CAST(position_group = '{g}' AS INTEGER) AS position_group_{g}" for g in ("RB", "WR_TE")]
        + [f"CAST(team = '{t}' AS INTEGER) AS \"team_{t}\"" for t in teams]
    )
    o["one_hot"] = flags(f"SELECT {KEYS}, team, {dummies} FROM panel")
    o["label_encode"] = flags(
        f"SELECT {KEYS}, code AS gsis_id_encoded FROM moves JOIN codes USING (gsis_id)",
        f"codes AS (SELECT gsis_id, row_number() OVER (ORDER BY s, o, gsis_id) - 1 AS code FROM ("
        f"SELECT gsis_id, season AS s, {ORDINAL} AS o, row_number() OVER ({BY_ENTITY}) AS k FROM moves) "
        "WHERE k = 1)",
    )
    o["target_encode"] = flags(
        f"SELECT {KEYS}, {r(_encoded('team', 5), 'team_encoded')}, "
        f"{r(_encoded('position_group', 10), 'position_encoded')} FROM panel"
    )
    o["random_split"] = flags(
        f"SELECT {KEYS}, CASE WHEN share < 70 THEN 'train' WHEN share < 85 THEN 'validation' "
        f"ELSE 'test' END AS data_split FROM (SELECT *, {_share('gsis_id', 'season', 'position_group')} "
        "AS share FROM panel)"
    )
    o["entity_holdout_split"] = flags(
        f"SELECT {KEYS}, CASE WHEN {_share('gsis_id')} < 20 THEN 'test' ELSE 'train' END "
        "AS data_split FROM panel"
    )
    o["feature_metadata"] = flags(
        _stacked(
            f"SELECT '{c}' AS column_name, '{TYPES[c]}' AS data_type, "
            f"{r(f'(count(*) - count({c})) * 100 / CAST(count(*) AS DOUBLE)', 'missing_pct')}, "
            f"count(DISTINCT {c}) AS n_distinct FROM panel"
            for c in PANEL
        )
    )
    quadratic = "c * c - s2 / n - s3 / s2 * c"
    size = "sqrt(s4 - s2 * s2 / n - s3 * s3 / s2)"
    o["orthogonal_poly2"] = flags(
        f"SELECT {KEYS}, {r('c / sqrt(s2)', 'age_poly1')}, {r(f'({quadratic}) / {size}', 'age_poly2')} "
        "FROM centred CROSS JOIN sums",
        "centred AS (SELECT gsis_id, season, position_group, age - (SELECT avg(age) FROM base) AS c FROM base), "
        "sums AS (SELECT count(c) AS n, sum(c * c) AS s2, sum(c * c * c) AS s3, sum(c * c * c * c) AS s4 FROM centred)",
    )
    panel_age = f"coalesce(age, (SELECT {_median('age')} FROM panel))"
    master = [
        r(_encoded("team", 5), "team_encoded"),
        r(_encoded("position_group", 10), "position_encoded"),
        r("filled * filled", "age_squared"),
        r("filled * filled * filled", "age_cubed"),
        r("exp(-0.1 * age)", "age_exp_decay"),
        "years_exp * years_exp AS exp_squared",
        "years_exp - 5 AS peak_years_away",
        r("age * post_transition", "age_post_interaction"),
        "years_exp * post_transition AS exp_post_interaction",
        r("team_quality * z_score", "quality_performance_interaction"),
        posts,
        *[r(_rolling("avg", w), f"z_score_roll{w}") for w in (2, 3)],
        *[r(_rolling("stddev_samp", w), f"z_score_vol{w}") for w in (2, 3)],
        r("m", "z_score_momentum"),
        r(f"m - lag(m) OVER ({BY_ENTITY})", "z_score_acceleration"),
        r(f"z_score - {FIRST_VALUE}", "z_score_cumulative_change"),
        r("pre_trend_slope", "performance_trajectory"),
        r(spread, "performance_variance"),
        f"{CONTRACT} AS likely_contract_year",
    ]
    o["master_features"] = flags(
        f"SELECT {cols(PANEL)}, {', '.join(master)} FROM stepped",
        f"stepped AS (SELECT *, {MOMENTUM} AS m, {panel_age} AS filled FROM panel)",
    )

    numbers = [c for c in NUMERIC if c != "season"] + ["metric_raw_scaled", "age_squared"]
    units = [c for c in numbers if c not in SCALING_EXCLUDED]
    others = [c for c in numbers if c not in units]
    labels = [c for c in STRINGS if c not in ("performance_level", "career_phase")]
    filled_in = ", ".join(
        f"coalesce(CAST({c} AS DOUBLE), {_median(c)} OVER (PARTITION BY position_group)) AS {c}" for c in numbers
    )
    named = ", ".join(
        f"coalesce({c}, (SELECT {c} FROM panel WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} "
        f"LIMIT 1), 'Unknown') AS {c}"
        for c in labels
    )
    kept = ", ".join(["season", "performance_level", "career_phase", *labels, *others])
    whole_column = ", ".join(
        f"coalesce({c}, (SELECT {_median(c)} FROM imputed)) AS {c}_full" for c in units
    )
    scaled_units = ", ".join(
        r(f"({c}_full - avg({c}_full) OVER ()) / coalesce(nullif(stddev_pop({c}_full) OVER (), 0), 1)", c)
        for c in units
    )
    prepared = (
        "enriched AS (SELECT *, metric_raw / (sd_season + 1e-10) AS metric_raw_scaled, "
        f"{LEVEL} AS performance_level, {_cut('years_exp', *CAREER, lower=0)} AS career_phase, "
        "age * age AS age_squared FROM panel), "
        f"imputed AS (SELECT DISTINCT season, performance_level, career_phase, {named}, {filled_in} FROM enriched), "
        f"fences AS ({_fences(units, 3, 'imputed')}), "
        f"capped AS (SELECT {kept}, {', '.join(f'{_capped(c)} AS {c}' for c in units)} FROM imputed), "
        f"complete AS (SELECT *, {whole_column} FROM capped)"
    )
    o["preprocess_panel"] = flags(
        f"SELECT season, performance_level, career_phase, {', '.join(labels)}, "
        f"{', '.join(r(c, c) for c in others)}, {scaled_units}, {TREND} AS pre_trend_category, "
        f"{_cut('years_exp', *EXPERIENCE, lower=0)} AS exp_group, {ADJUSTMENT} AS adjustment_phase, "
        f"{r('team_quality * z_score', 'quality_performance_interaction')}, "
        f"{_split(-2, 0)} AS data_split FROM complete",
        prepared,
    )

    kept = [c for c in NUMERIC if c not in FEATURE_EXCLUDED] + ["metric_raw_scaled", "age_squared"]
    axes = _components(kept, 10)
    scores = ", ".join(
        r(f"list_sum([x[i] * ws[{k}][i] FOR i IN range(1, {len(kept) + 1})])", f"PC{k}")
        for k in range(1, 11)
    )
    recursive = lambda sql: sql.replace("WITH ev AS", "WITH RECURSIVE ev AS", 1)
    o["pca_scores"] = recursive(flags(f"SELECT {KEYS}, {scores} FROM unit CROSS JOIN (SELECT list(w ORDER BY k) AS ws FROM loading)", axes))
    o["pca_explained_variance"] = recursive(
        flags(
            f"SELECT 'PC' || k AS \"Component\", {r('share', '\"Explained_Variance\"')}, "
            f"{r('sum(share) OVER (ORDER BY k)', '\"Cumulative_Variance\"')} FROM loading",
            axes,
        )
    )

    # -- models: what SQL can express of them
    features = [c for c in units if c not in (*MODEL_EXCLUDED, "z_score")]
    p = len(features) + 1
    value = lambda c: f"({c}_full - avg({c}_full) OVER ()) / coalesce(nullif(stddev_pop({c}_full) OVER (), 0), 1)"
    x = ", ".join([*map(value, features), "coalesce(team_quality * z_score, 0)"])
    around = lambda i: "(y - my)" if i > p else f"(x[{i}] - mx[{i}])"
    normal = ", ".join(
        "[" + ", ".join(f"sum({around(i)} * {around(j)})" + " + 1" * (i == j) for j in range(1, p + 2)) + "]"
        for i in range(1, p + 1)
    )
    means = ", ".join(f"avg(x[{i}])" for i in range(1, p + 1))
    framed = (
        f"{prepared}, framed AS (SELECT {KEYS}, {value('z_score')} AS y, [{x}] AS x, {_share('gsis_id')} AS share FROM complete), "
        f"centre AS (SELECT avg(y) AS my, [{means}] AS mx FROM framed WHERE share >= 20), "
    )
    predicted = (
        f"SELECT {KEYS}, position_group AS position, {r('y', 'actual')}, {r('yhat', 'predicted')}, "
        f"{r('y - yhat', 'error')}, {r('abs(y - yhat)', 'abs_error')} FROM (SELECT *, "
        f"my + list_sum([(x[i] - mx[i]) * b[i] FOR i IN range(1, {p + 1})]) AS yhat "
        "FROM framed CROSS JOIN centre CROSS JOIN slopes WHERE share < 20)"
    )
    o["ridge"] = recursive(
        flags(
            predicted,
            f"{framed}gauss(k, m) AS (SELECT 0, [{normal}] FROM framed CROSS JOIN centre WHERE share >= 20 UNION ALL SELECT k + 1, "
            f"[CASE WHEN i = k + 1 THEN [e / m[i][i] FOR e IN m[i]] ELSE "
            f"[m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1] FOR j IN range(1, {p + 2})] END FOR i IN range(1, {p + 1})] "
            f"FROM gauss WHERE k < {p}), "
            f"slopes AS (SELECT [row[{p + 1}] FOR row IN m] AS b FROM gauss WHERE k = {p})",
        )
    )
    products = ", ".join("[" + ", ".join(f"avg({around(i)} * {around(j)})" for j in range(1, p + 2)) + "]" for i in range(1, p + 1))
    # a sweep goes through the columns in turn: each step takes the slopes so far and a column's number
    j = "CAST(col[1] AS BIGINT)"
    rho = f"(m[{j}][{p + 1}] - list_sum([m[{j}][i] * now[i] FOR i IN range(1, {p + 1})]) + m[{j}][{j}] * now[{j}])"
    for name, l1, l2, sweeps in (("lasso", 0.1, 0.0, 150), ("elastic_net", 0.05, 0.05, 300)):
        step = f"CASE WHEN m[{j}][{j}] + {l2} > 0 THEN sign({rho}) * greatest(abs({rho}) - {l1}, 0) / (m[{j}][{j}] + {l2}) ELSE 0 END"
        sweep = f"list_reduce([b] || [[CAST(i AS DOUBLE)] FOR i IN range(1, {p + 1})], lambda now, col: now[1:{j} - 1] || [{step}] || now[{j} + 1:])"
        o[name] = recursive(
            flags(
                predicted,
                f"{framed}products AS (SELECT [{products}] AS m FROM framed CROSS JOIN centre WHERE share >= 20), "
                f"descent(k, b) AS (SELECT 0, [CAST(0 AS DOUBLE) FOR i IN range({p})] UNION ALL "
                f"SELECT k + 1, {sweep} FROM descent CROSS JOIN products WHERE k < {sweeps}), "
                f"slopes AS (SELECT b FROM descent WHERE k = {sweeps})",
            )
        )
    o["icc_null_model"] = single(
        f"SELECT n_entities, n_rows, {r('msb', 'ms_between')}, {r('msw', 'ms_within')}, {r('n0', 'n0')}, "
        f"{r('greatest((msb - msw) / n0, 0)', 'var_entity')}, "
        f"{r('greatest((msb - msw) / n0, 0) / (greatest((msb - msw) / n0, 0) + msw)', 'icc')} FROM parts",
        "grouped AS (SELECT *, avg(z_score) OVER (PARTITION BY gsis_id) AS mean_j, "
        "count(*) OVER (PARTITION BY gsis_id) AS n_j, avg(z_score) OVER () AS mean_all "
        "FROM panel WHERE z_score IS NOT NULL), parts AS (SELECT "
        "count(DISTINCT gsis_id) AS n_entities, count(*) AS n_rows, "
        "sum((mean_j - mean_all) * (mean_j - mean_all)) / (count(DISTINCT gsis_id) - 1) AS msb, "
        "sum((z_score - mean_j) * (z_score - mean_j)) / (count(*) - count(DISTINCT gsis_id)) AS msw, "
        "(count(*) - CAST(sum(n_j) AS DOUBLE) / count(*)) / (count(DISTINCT gsis_id) - 1) AS n0 "
        "FROM grouped)",
    )

    # -- chart tables
    o["trajectory_by_position"] = single(
        f"SELECT position_group, rel_time, count(z_score) AS n, {r('avg(z_score)', 'mean_z')}, "
        f"{r('stddev_samp(z_score) / sqrt(count(z_score))', 'se_z')} FROM panel GROUP BY 1, 2"
    )
    o["trajectory_loess"] = _loess(single)
    quarter = {n: _quantile("team_quality", p) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))}
    inside = "team_quality BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"
    o["boxplot_stats"] = flags(
        f"SELECT position_group, phase, {r('q1', 'q1')}, {r('median', 'median')}, {r('q3', 'q3')}, "
        f"{r(f'min(team_quality) FILTER (WHERE {inside})', 'whisker_low')}, "
        f"{r(f'max(team_quality) FILTER (WHERE {inside})', 'whisker_high')}, "
        f"count(*) FILTER (WHERE NOT ({inside})) AS n_outliers FROM panel "
        "JOIN boxes USING (position_group, phase) GROUP BY position_group, phase, "
        "boxes.q1, boxes.median, boxes.q3",
        "boxes AS (SELECT position_group, phase, "
        + ", ".join(f"{q} AS {n}" for n, q in quarter.items())
        + " FROM panel GROUP BY position_group, phase)",
    )
    line = "post_mean - pre_mean, pre_trend_slope"
    o["trend_lines"] = single(
        f"SELECT position_group, CAST(regr_count({line}) AS BIGINT) AS n, "
        f"{r(f'regr_slope({line})', 'slope')}, "
        f"{r(f'regr_intercept({line})', 'intercept')}, {r(f'regr_r2({line})', 'r2')} "
        "FROM change GROUP BY position_group",
        change,
    )
    low, high = NormalDist().inv_cdf(0.25), NormalDist().inv_cdf(0.75)
    grid = ", ".join(f"({i / 100}, {NormalDist().inv_cdf(i / 100)!r})" for i in range(1, 100))
    o["qq_points"] = flags(
        f"SELECT {r('CAST(p AS DOUBLE)', 'probability')}, {r('CAST(t AS DOUBLE)', 'theoretical')}, "
        f"{r('lo.error + (place - floor(place)) * (hi.error - lo.error)', 'sample')}, "
        f"{r(f'q1 + (q3 - q1) / ({high - low!r}) * (CAST(t AS DOUBLE) - ({low!r}))', 'line')} "
        "FROM places JOIN ranked lo ON lo.k = floor(place) JOIN ranked hi ON hi.k = ceil(place) "
        "CROSS JOIN quarters",
        f"grid(p, t) AS (VALUES {grid}), "
        "ranked AS (SELECT error, row_number() OVER (ORDER BY error) - 1 AS k FROM scored), "
        "places AS (SELECT p, t, CAST(p AS DOUBLE) * (SELECT max(k) FROM ranked) AS place FROM grid), "
        "quarters AS (SELECT quantile_cont(error, 0.25) AS q1, quantile_cont(error, 0.75) AS q3 FROM scored)",
    )
    o["residual_vs_fitted"] = flags(
        "SELECT CAST(least(floor((predicted - lo) / ((hi - lo) / 20)) + 1, 20) AS BIGINT) AS bin, "
        f"count(*) AS n, {r('avg(predicted)', 'mean_fitted')}, {r('avg(error)', 'mean_residual')} FROM scored "
        "CROSS JOIN ends GROUP BY 1",
        "ends AS (SELECT min(predicted) AS lo, max(predicted) AS hi FROM scored)",
    )
    o["error_histogram"] = flags(
        f"SELECT CAST(b AS INTEGER) AS bin, {r('lo + (b - 1) * (hi - lo) / 30', 'bin_low')}, "
        f"{r('lo + b * (hi - lo) / 30', 'bin_high')}, count(*) AS n FROM ("
        "SELECT least(floor((error - lo) / ((hi - lo) / 30)) + 1, 30) AS b, lo, hi FROM scored "
        "CROSS JOIN ends) GROUP BY b, lo, hi",
        "ends AS (SELECT min(error) AS lo, max(error) AS hi FROM scored)",
    )
    o["prediction_range"] = flags(
        f"SELECT {r('least(min(actual), min(predicted))', 'min_val')}, "
        f"{r('greatest(max(actual), max(predicted))', 'max_val')} FROM scored"
    )
    o["transition_effect"] = single(
        f"SELECT position_group, phase, count(*) AS n_rows, {r('avg(z_score)', 'mean_z')}, "
        f"{r('regr_slope(z_score, rel_time)', 'slope_z')}, {r('stddev_samp(z_score)', 'sd_z')} "
        "FROM panel GROUP BY 1, 2"
    )
    return o
