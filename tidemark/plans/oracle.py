"""SQL of the registered queries, as chains of common table expressions."""

from __future__ import annotations

from tidemark.operators.evaluate import NORMAL
from tidemark.plans.queries import ALPHAS, PERSISTENCES, THRESHOLDS

KPIS = ("load", "errors", "avg_value")
each = lambda f, sep=", ": sep.join(f.format(k=k) for k in KPIS)

_EW = "list_reduce(list(raw_{k}) OVER (PARTITION BY cell ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda a, x: x * 0.4::DOUBLE + a * 0.6::DOUBLE) AS z_{k}"
_HELD = "coalesce(sum(CASE WHEN abs(z_{k}) > 1.0 THEN 1 ELSE 0 END) OVER (PARTITION BY cell ORDER BY rn ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 2, false) AS f_{k}"

CTES = {
    "ev": "SELECT (user_id % 4)::INT AS cell, date_trunc('hour', ts)::TIMESTAMP AS ts, event_type, round(value * 100)::BIGINT AS cents FROM events",
    "hourly": "SELECT cell, ts, count(*) AS load, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'view') AS views, sum(cents)::BIGINT AS cents FROM ev GROUP BY 1, 2",
    "spine": "SELECT cell, unnest(generate_series((SELECT min(ts) FROM ev), (SELECT max(ts) FROM ev), INTERVAL 1 HOUR)) AS ts FROM (SELECT DISTINCT cell FROM ev)",
    "dense": "SELECT s.cell, s.ts, coalesce(load, 0) AS load, coalesce(errors, 0) AS errors, coalesce(views, 0) AS views, coalesce(cents, 0) AS cents FROM spine s LEFT JOIN hourly h ON h.cell = s.cell AND h.ts = s.ts",
    "high": "SELECT cell, quantile_cont(errors, 0.9) AS p_errors, quantile_cont(views, 0.9) AS p_views FROM dense GROUP BY 1",
    "named": "SELECT d.cell, ts, load::DOUBLE AS load, errors::DOUBLE AS errors, CASE WHEN load > 0 THEN cents / 100.0::DOUBLE / load ELSE 0.0 END AS avg_value, CASE WHEN errors >= p_errors AND errors > 0 THEN 'error_burst' WHEN views >= p_views AND views > 0 THEN 'view_surge' ELSE '' END AS scenario FROM dense d JOIN high h ON h.cell = d.cell",
    "kpi": "SELECT cell, ts, load, errors, avg_value, (scenario = 'error_burst')::INT AS label, scenario, row_number() OVER (PARTITION BY cell ORDER BY ts)::INT AS rn FROM named",
    "win": f"SELECT cell, ts, label, scenario, {each('{k}')}, (rn - 2)::INT AS rn FROM (SELECT cell, ts, label, scenario, rn, {each('avg({k}) OVER (PARTITION BY cell ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS {k}')} FROM kpi) WHERE rn >= 3",
    "train": "SELECT * FROM win WHERE rn <= 168",
    "test": "SELECT * REPLACE ((rn - 168)::INT AS rn) FROM win WHERE rn > 168",
    "bs": f"SELECT cell, ((isodow(ts) >= 6)::INT * 24 + hour(ts))::INT AS bucket, count(*) AS n, {each('avg({k}) AS mu_{k}, stddev_pop({k}) AS sd_{k}, min({k}) < max({k}) AS varies_{k}')} FROM train GROUP BY 1, 2",
    "gs": f"SELECT cell, {each('avg({k}) AS g_mu_{k}, stddev_pop({k}) AS g_sd_{k}')} FROM train GROUP BY 1",
    "z": f"SELECT t.*, ((isodow(t.ts) >= 6)::INT * 24 + hour(t.ts))::INT AS bucket, " + each("(t.{k} - CASE WHEN n >= 5 AND varies_{k} THEN mu_{k} ELSE g_mu_{k} END) / CASE WHEN (CASE WHEN n >= 5 AND varies_{k} THEN sd_{k} ELSE g_sd_{k} END) > 0 THEN (CASE WHEN n >= 5 AND varies_{k} THEN sd_{k} ELSE g_sd_{k} END) ELSE 1.0 END AS raw_{k}") + " FROM test t LEFT JOIN bs ON bs.cell = t.cell AND bs.bucket = ((isodow(t.ts) >= 6)::INT * 24 + hour(t.ts))::INT LEFT JOIN gs ON gs.cell = t.cell",
    "ew": f"SELECT *, {each(_EW)} FROM z",
    "fl": f"SELECT *, {each(_HELD)} FROM ew",
    "det": "SELECT cell, ts, label, scenario, rn, " + each("{k}, z_{k}") + ", (" + each("f_{k}", " OR ") + ")::INT AS alert, concat_ws(',', " + each("CASE WHEN f_{k} THEN '{k}' END") + ") AS trigger FROM fl",
    "ns": f"SELECT cell, {each('avg({k}) AS m_{k}, stddev_samp({k}) AS s_{k}')} FROM train GROUP BY 1",
    "nai": "SELECT t.*, (" + each("abs((t.{k} - m_{k}) / CASE WHEN s_{k} > 0 THEN s_{k} ELSE 1.0 END) > 1.5", " OR ") + ")::INT AS alert FROM test t JOIN ns ON ns.cell = t.cell",
    "seg": "SELECT * EXCLUDE (run_id, k) FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY n_alerts DESC, start_rn) AS k FROM (SELECT cell, run_id, min(rn) - 1 AS start_rn, max(rn) AS end_rn, min(ts) AS start_ts, max(ts) AS end_ts, sum(alert)::BIGINT AS n_alerts FROM (SELECT *, sum(edge) OVER (PARTITION BY cell ORDER BY rn) AS run_id FROM (SELECT *, (scenario <> '' AND lag(scenario, 1, '') OVER (PARTITION BY cell ORDER BY rn) = '')::INT AS edge FROM det)) WHERE scenario <> '' GROUP BY 1, 2)) WHERE k = 1",
    "inseg": "SELECT d.* FROM det d JOIN seg s ON s.cell = d.cell WHERE d.ts >= s.start_ts AND d.ts < s.end_ts",
    "log": "SELECT (user_id % 4)::INT AS partition, user_id AS key, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS \"offset\" FROM events",
}


def sql(final: str, *more: str, **instead: str) -> str:
    """WITH all expressions, some of them replaced, and any more of the form `name AS (...)`."""
    return "WITH " + ", ".join([*(f"{k} AS ({v})" for k, v in (CTES | instead).items()), *more]) + " " + final


def _runs(source: str, flag: str = "alert = 1", keys: str = "cell") -> str:
    """Rows of source whose flag holds, with run_id."""
    return f"SELECT * FROM (SELECT *, sum(edge) OVER (PARTITION BY {keys} ORDER BY rn) AS run_id FROM (SELECT *, ({flag} AND NOT coalesce(lag({flag}) OVER (PARTITION BY {keys} ORDER BY rn), false))::INT AS edge FROM {source})) WHERE {flag}"


def _events(source: str, keys: str = "cell") -> str:
    return f"SELECT * FROM (SELECT *, sum(ch) OVER (PARTITION BY {keys} ORDER BY rn) AS event_id FROM (SELECT *, (scenario <> lag(scenario, 1, '') OVER (PARTITION BY {keys} ORDER BY rn) AND scenario <> '')::INT AS ch FROM {source})) WHERE scenario <> ''"


def _hits(source: str, minutes: float, keys: str = "cell") -> str:
    return f"SELECT {keys}, event_id::BIGINT AS event_id, first(scenario) AS scenario, max(label) > 0 AS is_anomaly, min(CASE WHEN alert = 1 THEN rn END) IS NOT NULL AS hit, round((min(CASE WHEN alert = 1 THEN rn END) - min(rn)) * {minutes}::DOUBLE, 6) AS delay_min FROM ({_events(source, keys)}) GROUP BY {keys}, event_id"


def _false(source: str, keys: str = "cell") -> str:
    covered = f"(SELECT *, scenario <> '' AND max(label) OVER (PARTITION BY {keys}, stretch) > 0 AS covered FROM (SELECT *, sum(ch) OVER (PARTITION BY {keys} ORDER BY rn) AS stretch FROM (SELECT *, (scenario <> lag(scenario, 1, '') OVER (PARTITION BY {keys} ORDER BY rn))::INT AS ch FROM {source})))"
    return f"SELECT {keys}, run_id, coalesce(nullif(array_to_string(list_sort(list_distinct(list(scenario) FILTER (scenario <> ''))), ','), ''), '{NORMAL}') AS location FROM ({_runs(covered, keys=keys)}) GROUP BY {keys}, run_id HAVING NOT bool_or(covered)"


def _eval(source: str, minutes: float, keys: str = "cell") -> str:
    p, r = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0.0 END", "CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0.0 END"
    inner = f"SELECT b.*, coalesce(tp, 0) AS tp, coalesce(fn, 0) AS fn, coalesce(fp, 0) AS fp, mttd FROM (SELECT DISTINCT {keys} FROM {source}) b LEFT JOIN (SELECT {keys}, count(*) FILTER (hit) AS tp, count(*) FILTER (NOT hit) AS fn, avg(delay_min) AS mttd FROM ({_hits(source, minutes, keys)}) WHERE is_anomaly GROUP BY {keys}) USING ({keys}) LEFT JOIN (SELECT {keys}, count(*) AS fp FROM ({_false(source, keys)}) GROUP BY {keys}) USING ({keys})"
    return f"SELECT {keys}, tp, fn, fp, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1, round(coalesce(mttd, 'nan'::DOUBLE), 6) AS mttd_min FROM (SELECT *, {p} AS p, {r} AS r FROM ({inner}))"


def _win(entity: str, size: int, stride: int, agg: str) -> str:
    first = max(size, stride)
    w = f"PARTITION BY {entity} ORDER BY ts, event_id"
    return f"SELECT {entity}, ts, event_id, round(v, 6) AS value FROM (SELECT {entity}, ts, event_id, row_number() OVER ({w}) AS rn, {agg} OVER ({w} ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW) AS v FROM events) WHERE rn >= {first} AND (rn - {first}) % {stride} = 0"


_ONE = "one AS (SELECT user_id, ts, event_id, round(value * 100)::BIGINT AS cents FROM events WHERE event_id % 10 < 6)"
_TWO = "two AS (SELECT user_id, ts, event_id, round(value * 100)::BIGINT + 1000 AS cents FROM events WHERE event_id % 10 >= 4)"
_FIRST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS k FROM {t}) WHERE k = 1"
_NORMAL = each("avg({k}) AS m_{k}, stddev_samp({k}) AS s_{k}")
_SIGN = {"load": "", "errors": "", "avg_value": "-1.0 * "}
_BAD = "SELECT cell, scenario, kpi, deviation FROM (" + " UNION ALL ".join(f"SELECT k.cell, k.scenario, '{k}' AS kpi, max(CASE WHEN s_{k} > 0 THEN {_SIGN[k]}(k.{k} - m_{k}) / s_{k} END) AS deviation FROM kpi k JOIN nrm ON nrm.cell = k.cell WHERE k.scenario <> '' GROUP BY 1, 2" for k in KPIS) + ")"
_NRM = f"nrm AS (SELECT cell, {_NORMAL} FROM kpi WHERE scenario = '' GROUP BY 1)"
_SEGSTATS = "SELECT cell, count(*) AS n_rows, " + each("avg({k}) AS avg_{k}, max({k}) AS max_{k}, min({k}) AS min_{k}") + " FROM inseg GROUP BY 1"
_WHOLE = "SELECT d.* FROM det d JOIN seg s ON s.cell = d.cell WHERE d.ts >= s.start_ts AND d.ts < s.end_ts + INTERVAL 1 HOUR"
_SD = "CASE WHEN s_{k} > 0 THEN s_{k} ELSE 1.0 END"
_DEV = " UNION ALL ".join(f"SELECT s.cell, '{k}' AS kpi, {i} AS position, (avg_{k} - m_{k}) / {_SD.format(k=k)} AS avg_dev, CASE WHEN abs((max_{k} - m_{k}) / {_SD.format(k=k)}) >= abs((min_{k} - m_{k}) / {_SD.format(k=k)}) THEN (max_{k} - m_{k}) / {_SD.format(k=k)} ELSE (min_{k} - m_{k}) / {_SD.format(k=k)} END AS max_dev FROM ss s JOIN dn ON dn.cell = s.cell" for i, k in enumerate(KPIS))
_FIRED = (
    "trig AS (SELECT cell, trigger, count(*) AS n, row_number() OVER (PARTITION BY cell ORDER BY count(*) DESC, trigger) AS k FROM inseg WHERE trigger <> '' GROUP BY 1, 2 QUALIFY k <= 5), "
    "fired AS (SELECT cell, string_agg(trigger || ':' || n, ' ' ORDER BY k) AS triggers, list_sort(list_distinct(flatten(list(string_split(trigger, ','))))) AS f FROM trig GROUP BY 1)"
)
_INCIDENT = (
    "SELECT d.cell, s.start_ts, s.end_ts, ss.n_rows, (SELECT coalesce(sum(alert), 0)::BIGINT FROM inseg i WHERE i.cell = d.cell) AS n_alerts, (SELECT min(ts) FROM inseg i WHERE i.cell = d.cell AND alert = 1) AS first_alert, "
    "coalesce(triggers, '') AS triggers, row_number() OVER (PARTITION BY d.cell ORDER BY abs(round(max_dev, 2)) DESC, position)::INT AS rank, kpi, round(CASE kpi " + " ".join(f"WHEN '{k}' THEN m_{k}" for k in KPIS) + " END, 3) AS normal_mean, "
    "round(CASE kpi " + " ".join(f"WHEN '{k}' THEN avg_{k}" for k in KPIS) + " END, 3) AS segment_mean, round(avg_dev, 2) AS avg_dev, round(max_dev, 2) AS max_dev, coalesce(list_contains(f, kpi), false) AS kpi_fired, 1.0::DOUBLE AS z_threshold, "
    "coalesce(array_to_string(f, ','), '') AS fired, array_to_string(list_sort(list_filter(['" + "', '".join(KPIS) + "'], lambda x: NOT coalesce(list_contains(f, x), false))), ',') AS not_fired "
    "FROM dv d JOIN seg s ON s.cell = d.cell JOIN ss ON ss.cell = d.cell JOIN dn ON dn.cell = d.cell LEFT JOIN fired ON fired.cell = d.cell"
)
_POINTS = "SELECT cell, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0.0 END AS r FROM (SELECT cell, count(*) FILTER (alert = 1 AND label = 1) AS tp, count(*) FILTER (alert = 1 AND label <> 1) AS fp, count(*) FILTER (alert <> 1 AND label = 1) AS fn FROM {t} GROUP BY 1))"
_GOT = "got AS (SELECT user_id, event_id, value + CASE WHEN event_id % 101 = 0 THEN 0.5 ELSE 0.0 END AS value FROM events WHERE event_id % 97 <> 0 UNION ALL SELECT user_id, -event_id - 1, value FROM events WHERE event_id % 211 = 0)"
_EMIT = "em AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY \"offset\") AS rn FROM log)"


def _resume(stride: int, where: str = "true", size: int = 5) -> str:
    return f"SELECT l.partition, l.key, CASE WHEN e IS NULL THEN lo ELSE coalesce(n.\"offset\", last_at + 1) END AS resume FROM (SELECT partition, key, min(\"offset\") AS lo, max(CASE WHEN rn >= {size} AND (rn - {size}) % {stride} = 0 THEN rn END) AS e, max(CASE WHEN rn >= {size} AND (rn - {size}) % {stride} = 0 THEN \"offset\" END) AS last_at FROM em WHERE {where} GROUP BY 1, 2) l LEFT JOIN (SELECT * FROM em WHERE {where}) n ON n.key = l.key AND n.rn = l.e - {size} + 1 + {stride}"


def _crash() -> str:
    done, end = 90, 120
    runs = f"SELECT p.partition, rule, least(CASE rule WHEN 'on_read' THEN {end} WHEN 'last_after_write' THEN {done} ELSE coalesce(safe, 0) END, top + 1) AS start FROM (SELECT partition, max(\"offset\") AS top FROM log GROUP BY 1) p LEFT JOIN (SELECT partition, min(resume) AS safe FROM ({_resume(1, f'\"offset\" < {done}')}) GROUP BY 1) s ON s.partition = p.partition, (VALUES ('on_read'), ('last_after_write'), ('window_safe')) r(rule)"
    rows = f"SELECT rule, rn >= 5 AS emits, \"offset\" < {done} AND rn >= 5 AS one, \"offset\" >= start AND sum((\"offset\" >= start)::INT) OVER (PARTITION BY rule, key ORDER BY \"offset\") >= 5 AS two, \"offset\" >= start AND \"offset\" < {end} AS again FROM em JOIN ({runs}) r ON r.partition = em.partition"
    return f"SELECT rule, count(*) FILTER (again) AS n_reread, count(*) FILTER (emits AND NOT one AND NOT two) AS n_lost, count(*) FILTER (one AND two) AS n_again FROM ({rows}) GROUP BY 1"


_GRID = "grid AS (SELECT z_threshold::DOUBLE AS z_threshold, persistence::INT AS persistence FROM (VALUES " + ", ".join(f"({t})" for t in THRESHOLDS) + ") a(z_threshold), (VALUES " + ", ".join(f"({p})" for p in PERSISTENCES) + ") b(persistence))"
_FIRE = " OR ".join(f"coalesce(CASE persistence " + " ".join(f"WHEN {p} THEN sum((abs(z_{k}) > z_threshold)::INT) OVER (PARTITION BY cell, z_threshold, persistence ORDER BY rn ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW) = {p}" for p in PERSISTENCES) + " END, false)" for k in KPIS)
_SWEPT = f"swept AS (SELECT cell, rn, ts, label, scenario, z_threshold, persistence, ({_FIRE})::INT AS alert FROM ew, grid)"

_SETTINGS = "settings AS (SELECT DISTINCT alpha::DOUBLE AS alpha, z_threshold::DOUBLE AS z_threshold, persistence::INT AS persistence FROM (VALUES " + ", ".join([*(f"({a}, 1.0, 2)" for a in ALPHAS), *(f"(0.4, {t}, 2)" for t in THRESHOLDS), *(f"(0.4, 1.0, {p})" for p in PERSISTENCES)]) + ") v(alpha, z_threshold, persistence))"
_KEYS = "cell, alpha, z_threshold, persistence"
_SMOOTH = f"smooth AS (SELECT rn, ts, label, scenario, {_KEYS}, " + each("list_reduce(list(raw_{k}) OVER (PARTITION BY cell, alpha, z_threshold, persistence ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda a, x: x * alpha + a * (1 - alpha)) AS z_{k}") + " FROM z, settings)"
_ONE_AT_A_TIME = f"swept AS (SELECT rn, ts, label, scenario, {_KEYS}, ({_FIRE.replace('cell, z_threshold, persistence', _KEYS)})::INT AS alert FROM smooth)"
_SPREAD = ", ".join(f"round({f}(CASE WHEN NOT isnan({c}) THEN {c} END), 6) AS {c}_{n}" for c in ("precision", "recall", "mttd_min") for f, n in (("avg", "mean"), ("stddev_pop", "std"), ("min", "min"), ("max", "max")))

ORACLES = {
    "sweep_one_at_a_time": sql(_eval("swept", 60, _KEYS), _SETTINGS, _SMOOTH, _ONE_AT_A_TIME),
    "metrics_across_cells": sql(f"SELECT cell % 2 AS half, {_SPREAD} FROM ({_eval('det', 60)}) GROUP BY 1"),
    "label_totals": sql("SELECT cell, count(*) AS n_rows, count(*) FILTER (label = 1) AS n_anomaly, count(*) FILTER (scenario <> '' AND label = 0) AS n_trap, round(avg(label) * 100, 6) AS anomaly_pct FROM kpi GROUP BY 1"),
    "win_mean_by_user": _win("user_id", 5, 1, "avg(value)"),
    "win_max_stride2": _win("user_id", 5, 2, "max(value)"),
    "win_p95_event_type": _win("event_type", 5, 1, "quantile_cont(value, 0.95)"),
    "win_gap_stride_gt_size": _win("user_id", 3, 7, "avg(value)"),
    "stream_windows_by_user": _win("user_id", 5, 1, "avg(value)"),
    "rolling_zscore_60": "SELECT event_type, event_id, round(CASE WHEN rn >= 60 AND s > 0 THEN (value - m) / s END, 6) AS z FROM (SELECT event_type, event_id, value, row_number() OVER w AS rn, avg(value) OVER f AS m, stddev_samp(value) OVER f AS s FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id), f AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))",
    "ewma_by_event_type": "WITH RECURSIVE o AS MATERIALIZED (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events), s AS (SELECT event_type, event_id, rn, value AS v FROM o WHERE rn = 1 UNION ALL SELECT o.event_type, o.event_id, o.rn, 0.01::DOUBLE * o.value + 0.99::DOUBLE * s.v FROM s JOIN o ON o.event_type = s.event_type AND o.rn = s.rn + 1) SELECT event_type, event_id, round(v, 6) AS smooth_value FROM s",
    "kpi_frame": sql("SELECT cell, ts, round(load, 6) AS load, round(errors, 6) AS errors, round(avg_value, 6) AS avg_value, label, scenario, rn FROM kpi"),
    "kpi_windows": sql("SELECT cell, ts, label, scenario, rn, " + each("round({k}, 6) AS {k}") + " FROM win"),
    "bucket_keys": "SELECT ((isodow(ts) >= 6)::INT * 48 + (hour(ts) * 60 + minute(ts)) // 30)::INT AS bucket, count(*) AS n FROM events GROUP BY 1",
    "baseline_bucket_stats": sql("SELECT cell, bucket, n, " + each("round(mu_{k}, 6) AS mu_{k}, round(sd_{k}, 6) AS sd_{k}, varies_{k}") + " FROM bs"),
    "baseline_global_stats": sql("SELECT cell, " + each("round(g_mu_{k}, 6) AS g_mu_{k}, round(g_sd_{k}, 6) AS g_sd_{k}") + " FROM gs"),
    "zscore_with_fallback": sql("SELECT cell, rn, bucket, " + each("round(raw_{k}, 6) AS raw_{k}") + " FROM z"),
    "ewma_z": sql("SELECT cell, rn, " + each("round(z_{k}, 6) AS z_{k}") + " FROM ew"),
    "persistence_runs": sql("SELECT cell, rn, coalesce(sum((abs(round(raw_load, 9)) > 1.0)::INT) OVER (PARTITION BY cell ORDER BY rn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3, false)::INT AS held FROM z"),
    "detect_alerts": sql("SELECT cell, rn, ts, alert, trigger FROM det"),
    "detect_naive_alerts": sql("SELECT cell, rn, alert FROM nai"),
    "alert_runs": sql(f"SELECT cell, run_id::BIGINT AS run_id, (min(rn) - 1)::INT AS start_rn, max(rn) AS end_rn, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_rows FROM ({_runs('det')}) GROUP BY cell, run_id"),
    "scenario_events": sql(f"SELECT cell, event_id::BIGINT AS event_id, first(scenario) AS scenario, (min(rn) - 1)::INT AS start_rn, max(rn) AS end_rn, max(label) > 0 AS is_anomaly FROM ({_events('kpi')}) GROUP BY cell, event_id"),
    "event_hits_delay": sql(_hits("det", 60)),
    "evaluate_metrics": sql(_eval("det", 60)),
    "evaluate_mixed_events": sql(_eval("mixed", 60), "mixed AS (SELECT * REPLACE ((scenario <> '' AND rn % 3 = 0)::INT AS label) FROM det)"),
    "delays_by_scenario": sql(f"SELECT cell, scenario, (row_number() OVER (PARTITION BY cell, scenario ORDER BY delay_min) - 1)::INT AS place, delay_min FROM ({_hits('det', 60)}) WHERE is_anomaly AND delay_min IS NOT NULL"),
    "incident_summary": sql(_INCIDENT, f"ss AS ({_SEGSTATS})", f"dn AS (SELECT cell, {_NORMAL} FROM det WHERE scenario = '' GROUP BY 1)", f"dv AS ({_DEV})", _FIRED),
    "evaluate_per_scenario": sql(f"SELECT cell, scenario, count(*) AS total, count(*) FILTER (hit) AS hit, round(avg(delay_min), 6) AS mean_delay_min FROM ({_hits('det', 60)}) WHERE is_anomaly GROUP BY 1, 2"),
    "fp_by_location": sql(f"SELECT cell, location, count(*) AS n_false FROM ({_false('det')}) GROUP BY 1, 2"),
    "fp_reduction": sql(f"SELECT cell, a.fp AS fp_proposed, b.fp AS fp_naive, round(CASE WHEN b.fp <> 0 THEN (1 - a.fp / b.fp::DOUBLE) * 100 ELSE 'nan'::DOUBLE END, 6) AS reduction_pct FROM ({_eval('det', 1)}) a JOIN ({_eval('nai', 1)}) b USING (cell)"),
    "point_confusion": sql(_POINTS.format(t="nai")),
    "scenario_alert_summary": sql("SELECT cell, scenario, count(*) AS n_rows, sum(alert)::BIGINT AS n_alerts FROM det GROUP BY 1, 2"),
    "best_segment": sql("SELECT cell, start_rn::INT AS start_rn, end_rn, start_ts, end_ts, n_alerts FROM seg"),
    "segment_summary": sql("SELECT cell, n_rows, " + each("round(avg_{k}, 6) AS avg_{k}, round(max_{k}, 6) AS max_{k}, round(min_{k}, 6) AS min_{k}") + f" FROM ({_SEGSTATS})", inseg=_WHOLE),
    "normal_reference_stats": sql("SELECT cell, " + each("round(avg({k}), 6) AS mean_{k}, round(stddev_samp({k}), 6) AS std_{k}") + " FROM det WHERE scenario = '' GROUP BY 1"),
    "segment_alerts": sql("SELECT cell, sum(alert)::BIGINT AS n_alerts, min(CASE WHEN alert = 1 THEN ts END) AS first_alert FROM inseg GROUP BY 1", inseg=_WHOLE),
    "top_triggers": sql("SELECT * FROM (SELECT cell, trigger, count(*) AS n, row_number() OVER (PARTITION BY cell ORDER BY count(*) DESC, trigger)::INT AS rank FROM det WHERE trigger <> '' GROUP BY 1, 2) WHERE rank <= 3"),
    "kpi_deviation_rank": sql("SELECT cell, kpi, position, round(avg_dev, 6) AS avg_dev, round(max_dev, 6) AS max_dev, row_number() OVER (PARTITION BY cell ORDER BY abs(round(max_dev, 9)) DESC, position)::INT AS rank FROM dv", f"ss AS ({_SEGSTATS})", f"dn AS (SELECT cell, {_NORMAL} FROM det WHERE scenario = '' GROUP BY 1)", f"dv AS ({_DEV})", inseg=_WHOLE),
    "naive_only_fp_longest": sql("SELECT cell, start_rn, end_rn, n_rows FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY n_rows DESC, start_rn) AS k FROM (SELECT cell, run_id, (min(rn) - 1)::INT AS start_rn, max(rn) AS end_rn, count(*) AS n_rows, max(proposed) AS o FROM (" + _runs("(SELECT d.cell, d.rn, d.alert AS proposed, (n.alert = 1 AND d.label = 0) AS fn_ FROM det d JOIN nai n ON n.cell = d.cell AND n.rn = d.rn)", "fn_") + ") GROUP BY 1, 2) WHERE o = 0) WHERE k = 1"),
    "best_segment_of_scenario": sql("SELECT cell, (start_rn - 1)::INT AS start_rn, end_rn::INT AS end_rn, start_ts, end_ts, n_alerts FROM (SELECT cell, run_id, min(rn) AS start_rn, max(rn) AS end_rn, min(ts) AS start_ts, max(ts) AS end_ts, sum(alert)::BIGINT AS n_alerts FROM (" + _runs("det", "scenario = 'view_surge'") + ") GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY cell ORDER BY n_alerts DESC, start_rn) = 1"),
    "rows_around_bursts": sql("SELECT d.cell, b.run_id::BIGINT AS segment, d.rn, (d.rn - b.lo)::INT AS place, d.alert FROM det d JOIN (SELECT cell, run_id, min(rn) AS lo, max(rn) AS hi FROM (" + _runs("det", "scenario = 'error_burst'") + ") GROUP BY 1, 2) b ON b.cell = d.cell AND d.rn BETWEEN b.lo - 2 AND b.hi + 2"),
    "naive_only_fp_slice": sql("SELECT b.cell, b.rn, ts, round(load, 6) AS load, label, alert, naive_alert FROM both_ b JOIN longest l ON l.cell = b.cell AND b.rn BETWEEN l.lo - 3 AND l.hi + 3", "both_ AS (SELECT d.*, n.alert AS naive_alert FROM det d JOIN nai n ON n.cell = d.cell AND n.rn = d.rn)", "longest AS (SELECT cell, lo, hi FROM (SELECT cell, run_id, min(rn) AS lo, max(rn) AS hi, max(alert) AS o FROM (" + _runs("both_", "(naive_alert = 1 AND label = 0)") + ") GROUP BY 1, 2) WHERE o = 0 QUALIFY row_number() OVER (PARTITION BY cell ORDER BY hi - lo DESC, lo) = 1)"),
    "plot_series": sql("SELECT cell, pixel, min(ts) AS start, max(ts) AS \"end\", count(*) AS n_rows, " + ", ".join(f"round({f}, 6) AS {n}_{k}" for k in ("load", "avg_value") for n, f in (("min", f"min({k})"), ("max", f"max({k})"), ("first", f"arg_min({k}, rn)"), ("last", f"arg_max({k}, rn)"))) + ", sum(alert)::BIGINT AS n_alert, sum(naive)::BIGINT AS n_naive_alert FROM (SELECT d.*, n.alert AS naive, ((row_number() OVER (PARTITION BY d.cell ORDER BY d.rn) - 1) * 40 // count(*) OVER (PARTITION BY d.cell))::INT AS pixel FROM det d JOIN nai n ON n.cell = d.cell AND n.rn = d.rn) GROUP BY 1, 2"),
    "plot_shading": sql(" UNION ALL ".join(f"SELECT cell, '{kind}' AS kind, (min(rn) - 1)::INT AS start_rn, max(rn) AS end_rn, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_rows FROM ({_runs('det', flag)}) GROUP BY cell, run_id" for kind, flag in (("alert", "(alert = 1)"), ("anomaly", "(label = 1)"), ("trap", "(scenario <> '' AND label = 0)")))),
    "skeleton_confusion": sql(_POINTS.format(t="sk"), "sk AS (SELECT cell, label, coalesce(abs(round(z, 9)) > 1.5, false)::INT AS alert FROM (SELECT cell, label, CASE WHEN rn >= 24 AND s > 0 THEN (load - m) / s END AS z FROM (SELECT cell, label, load, rn, avg(load) OVER f AS m, stddev_samp(load) OVER f AS s FROM kpi WINDOW f AS (PARTITION BY cell ORDER BY rn ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))))"),
    "latency_produced_to_ingested": "SELECT part, count(*) AS n, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95, round(max(ms), 6) AS max FROM (SELECT user_id % 4 AS part, (epoch_us(date_trunc('hour', ts) + INTERVAL 1 HOUR) - epoch_us(ts)) / 1000.0::DOUBLE AS ms FROM events) GROUP BY 1",
    "next_offset_by_partition": sql("SELECT partition, max(\"offset\") + 1 AS next_offset FROM log GROUP BY 1"),
    "frame_diff_by_digest": f"WITH {_GOT} SELECT user_id, event_id, CASE WHEN g.here IS NULL THEN 'missing' WHEN e.here IS NULL THEN 'extra' ELSE 'mismatched' END AS difference, round(e.value, 6) AS e_value, round(g.value, 6) AS g_value FROM (SELECT *, 1 AS here FROM events) e FULL OUTER JOIN (SELECT *, 1 AS here FROM got) g USING (user_id, event_id) WHERE e.here IS NULL OR g.here IS NULL OR NOT abs(e.value - g.value) <= 1e-9 + 1e-9 * abs(g.value)",
    "latency_percentiles": "SELECT part, count(*) AS n, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95, round(max(ms), 6) AS max_ms FROM (SELECT user_id % 4 AS part, (epoch_us(lead(ts) OVER (PARTITION BY user_id % 4 ORDER BY event_id)) - epoch_us(ts)) / 1000.0::DOUBLE AS ms FROM events) WHERE ms IS NOT NULL GROUP BY 1",
    "count_by_key": "SELECT user_id, count(*) AS n FROM events GROUP BY 1",
    "expected_windows_by_key": "SELECT user_id, n, CASE WHEN n < 5 THEN 0 ELSE (n - 5) // 2 + 1 END AS n_windows FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)",
    "windows_count_check": f"SELECT user_id, n_records, n_expected, coalesce(n_stored, 0) AS n_stored, n_expected = coalesce(n_stored, 0) AS ok FROM (SELECT user_id, count(*) AS n_records, CASE WHEN count(*) < 5 THEN 0 ELSE (count(*) - 5) // 2 + 1 END AS n_expected FROM events GROUP BY 1) LEFT JOIN (SELECT user_id, count(*) AS n_stored FROM ({_win('user_id', 5, 2, 'avg(value)')}) GROUP BY 1) USING (user_id)",
    "key_partition_audit": "SELECT event_type, count(DISTINCT user_id % 7 % 4) AS n_partitions, count(*) AS n_rows, count(DISTINCT user_id % 7 % 4) > 1 AS is_split FROM events GROUP BY 1",
    "partition_skew": "SELECT part, n_keys, n_rows, round(max(n_keys) OVER () / avg(n_keys) OVER (), 6) AS max_over_mean FROM (SELECT p::INT AS part, coalesce(n_keys, 0) AS n_keys, coalesce(n_rows, 0) AS n_rows FROM range(5) r(p) LEFT JOIN (SELECT user_id % 7 % 4 AS part, count(DISTINCT user_id) AS n_keys, count(*) AS n_rows FROM events GROUP BY 1) e ON e.part = r.p)",
    "outer_diff_by_key": f"WITH {_GOT} SELECT user_id, count(e.event_id) AS n_expected, count(g.event_id) AS n_got, count(*) FILTER (g.event_id IS NULL) AS n_missing, count(*) FILTER (e.event_id IS NULL) AS n_extra, count(*) FILTER (e.event_id IS NOT NULL AND g.event_id IS NOT NULL AND abs(e.value - g.value) > 1e-9 + 1e-9 * abs(g.value)) AS n_mismatched FROM events e FULL OUTER JOIN got g USING (user_id, event_id) GROUP BY 1",
    "idempotent_upsert": f"WITH {_ONE}, {_TWO}, s AS ({_FIRST.format(t='one')}), n AS (SELECT * FROM ({_FIRST.format(t='two')}) t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = t.user_id AND s.ts = t.ts)) SELECT user_id, batch, count(*) AS n, sum(cents)::BIGINT AS cents FROM (SELECT user_id, cents, 1 AS batch FROM s UNION ALL SELECT user_id, cents, 2 FROM n) GROUP BY 1, 2",
    "resume_positions": sql(_resume(2), _EMIT),
    "partition_resume": sql(f"SELECT partition, min(resume) AS resume FROM ({_resume(1)}) GROUP BY 1", _EMIT),
    "crash_loss_matrix": sql(_crash(), _EMIT),
    "commit_regressions": "SELECT part, count(*) FILTER (position < before) AS n_regressions FROM (SELECT part, position, lag(position) OVER (PARTITION BY part ORDER BY event_id) AS before FROM (SELECT (user_id % 4)::INT AS part, event_id, event_id - event_id % 7 * 3 AS position FROM events)) GROUP BY 1",
    "param_sweep_eval": sql(_eval("swept", 60, "cell, z_threshold, persistence"), _GRID, _SWEPT),
    "clip_saturation": sql(" UNION ALL ".join(f"SELECT cell, '{k}' AS kpi, count(*) FILTER ({k} <= {lo} + 1e-9) AS n_low, count(*) FILTER ({k} >= {hi} - 1e-9) AS n_high FROM kpi GROUP BY 1" for k, lo, hi in (("load", 0.0, 5.0), ("errors", 0.0, 2.0), ("avg_value", 0.0, 100.0)))),
    "bad_direction_deviation": sql(f"SELECT cell, scenario, kpi, round(deviation, 6) AS deviation FROM ({_BAD})", _NRM),
    "load_quality_split": sql(f"SELECT cell, round(a, 6) AS least_load, round(b, 6) AS most_quality, coalesce(a > b, false) AS ok FROM (SELECT cell, min(deviation) FILTER (kpi = 'load') AS a, max(deviation) FILTER (kpi <> 'load') AS b FROM ({_BAD}) WHERE scenario = 'view_surge' GROUP BY 1)", _NRM),
    "warmup_purity": sql("SELECT cell, round(avg(label), 6) AS label_mean, count(*) FILTER (scenario <> '') AS n_scenario_rows FROM kpi WHERE rn <= 168 GROUP BY 1"),
}
