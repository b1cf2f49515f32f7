"""Independent ANSI-SQL (DuckDB) statements for the registered queries.

These are the correctness oracle: each statement recomputes a query from
the raw tables with plain SQL (a recursive CTE for the ARIMA residuals),
sharing nothing with the Spark code but the definitions in FIXTURES.md.
The builders below only assemble common-table-expression text.
"""

from __future__ import annotations

from planwell import config as C

CUTOFF = C.DEFAULT_CUTOFF

VIEWS = {
    "volume": """volume AS (
  SELECT CAST(l_shipdate AS DATE) AS date, p_brand AS series_key, COUNT(*) AS cnt
  FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE l_shipdate IS NOT NULL AND p_brand IS NOT NULL
  GROUP BY 1, 2)""",
    "volume_orders": """volume_orders AS (
  SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS series_key, COUNT(*) AS cnt
  FROM orders WHERE o_orderdate IS NOT NULL AND o_orderpriority IS NOT NULL
  GROUP BY 1, 2)""",
    "volume_two_key": """volume_two_key AS (
  SELECT CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS date,
         n_name AS site, o_orderstatus AS series_key, COUNT(*) AS cnt
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE o_orderdate IS NOT NULL
  GROUP BY 1, 2, 3)""",
    "ingest_batch": """ingest_batch AS (
  SELECT CAST(ts AS DATE) AS date, event_type AS series_key, COUNT(*) AS cnt
  FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL
  GROUP BY 1, 2)""",
    "learners": """learners AS (
  SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS record_id,
         n_name AS site, p_brand AS course, CAST(p_size AS INTEGER) AS age,
         CASE l_linestatus WHEN 'O' THEN 'Male' WHEN 'F' THEN 'Female' END AS sex, o_orderpriority AS education, l_returnflag AS employment,
         p_type AS skill, c_mktsegment AS career, o_orderstatus AS classification,
         CASE WHEN l_quantity * (1.0 - l_discount) >= 24.0 THEN 'Graduate' ELSE 'Dropout' END AS outcome
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey
       JOIN part ON l_partkey = p_partkey)""",
    "predictions": """predictions AS (
  SELECT l.doc_id, CAST(l.quality AS INTEGER) AS label,
         l.toxic * 0.5 + 0.5::DOUBLE * (CAST(d.n_chars AS DOUBLE) / (CAST(d.n_chars AS DOUBLE) + 20000.0::DOUBLE)) AS score,
         CAST(l.toxic * 0.5 + 0.5::DOUBLE * (CAST(d.n_chars AS DOUBLE) / (CAST(d.n_chars AS DOUBLE) + 20000.0::DOUBLE)) >= 0.25 AS INTEGER) AS pred
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)""",
}

PERIOD_EXPR = {
    "week": "CAST(date_trunc('week', date) + INTERVAL 6 DAY AS DATE)",
    "month": "CAST(date_trunc('month', date) AS DATE)",
    "day": "date",
}
STEP = {"week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH", "day": "INTERVAL 1 DAY"}


def _keys(keys: list[str], prefix: str = "") -> str:
    return "".join(f"{prefix}{k}, " for k in keys)


def _on(keys: list[str], a: str, b: str) -> str:
    return " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)


def series_cte(name: str, source: str, keys: list[str], grain: str,
               cutoff: str | None = None, fill: bool = True) -> str:
    """Regular series ``name``(keys, <grain>, t, y) from a daily-count source."""
    where = f"WHERE date <= DATE '{cutoff}'" if cutoff else ""
    kk = _keys(keys)
    y = "CAST(coalesce(o.y, 0) AS DOUBLE)" if fill else "CAST(o.y AS DOUBLE)"
    join_on = " AND ".join([*(f"s.{k} = o.{k}" for k in keys), f"s.{grain} = o.{grain}"])
    return f"""{name}_obs AS (
  SELECT {kk}{PERIOD_EXPR[grain]} AS {grain}, SUM(cnt) AS y FROM {source} {where}
  GROUP BY ALL),
{name}_spine AS (
  SELECT {kk}CAST(unnest(generate_series(CAST(min({grain}) AS TIMESTAMP), CAST(max({grain}) AS TIMESTAMP), {STEP[grain]})) AS DATE) AS {grain}
  FROM {name}_obs {('GROUP BY ' + ', '.join(keys)) if keys else ''}),
{name} AS (
  SELECT {_keys(keys, 's.')}s.{grain},
         CAST(row_number() OVER ({('PARTITION BY ' + ', '.join('s.' + k for k in keys)) if keys else ''} ORDER BY s.{grain}) - 1 AS INTEGER) AS t,
         {y} AS y
  FROM {name}_spine s LEFT JOIN {name}_obs o ON {join_on})"""


def arima_ctes(name: str, series: str, keys: list[str],
               denominator: int = C.GRID_DENOMINATOR) -> str:
    """Recursive CSS scan over every grid point: ``{name}_rec``(keys, phi, theta, t, e, dlag, sse)
    where t is the index of the difference (1 = y_1 - y_0), plus ``{name}_grid`` and ``{name}_diff``."""
    kk = _keys(keys)
    on = _on(keys, "s", "r")
    on = (on + " AND ") if on else ""
    den = denominator
    return f"""{name}_vals AS (
  SELECT CAST(i AS DOUBLE) / CAST({den} AS DOUBLE) AS v FROM range(-{den - 1}, {den}) r(i)),
{name}_grid AS (
  SELECT a.v AS phi, b.v AS theta FROM {name}_vals a, {name}_vals b
  WHERE a.v <> -b.v OR (a.v = 0 AND b.v = 0)),
{name}_diff AS (
  SELECT {kk}t, y - lag(y) OVER ({('PARTITION BY ' + ', '.join(keys)) if keys else ''} ORDER BY t) AS d
  FROM {series}),
{name}_rec AS (
  SELECT {_keys(keys, 's.')}g.phi, g.theta, s.t,
         CASE WHEN s.d IS NULL THEN 0.0 ELSE s.d - g.phi * 0.0 - g.theta * 0.0 END AS e,
         coalesce(s.d, 0.0) AS dlag,
         CASE WHEN s.d IS NULL THEN 0.0
              ELSE (s.d - g.phi * 0.0 - g.theta * 0.0) * (s.d - g.phi * 0.0 - g.theta * 0.0) END AS sse
  FROM {name}_diff s, {name}_grid g WHERE s.t = 1
  UNION ALL
  SELECT {_keys(keys, 'r.')}r.phi, r.theta, s.t,
         CASE WHEN s.d IS NULL THEN 0.0 ELSE s.d - r.phi * r.dlag - r.theta * r.e END,
         coalesce(s.d, 0.0),
         CASE WHEN s.d IS NULL THEN r.sse
              ELSE r.sse + (s.d - r.phi * r.dlag - r.theta * r.e) * (s.d - r.phi * r.dlag - r.theta * r.e) END
  FROM {name}_rec r JOIN {name}_diff s ON {on}s.t = r.t + 1)"""


def refine_ctes(name: str, cells: str, keys: list[str], denominator: int = C.GRID_DENOMINATOR, refine: int = C.GRID_REFINE) -> str:
    """The second search around grid points: ``{name}_rec2``(keys, phi0, theta0, phi, theta, t, e, dlag, sse) for the
    distinct (keys, phi, theta) of ``cells``, over the differences of ``{name}_diff``."""
    kk, fine = _keys(keys), denominator * refine
    on = "".join(f"s.{k} = p.{k} AND " for k in keys)
    on_r = "".join(f"s.{k} = r.{k} AND " for k in keys)
    return f"""{name}_points AS (
  SELECT {kk}phi0, theta0, CAST(i AS DOUBLE) / CAST({fine} AS DOUBLE) AS phi, CAST(j AS DOUBLE) / CAST({fine} AS DOUBLE) AS theta
  FROM (SELECT {kk}phi0, theta0, CAST(round(phi0 * {denominator}) AS INTEGER) * {refine} + a.x AS i,
               CAST(round(theta0 * {denominator}) AS INTEGER) * {refine} + b.x AS j
        FROM (SELECT DISTINCT {kk}phi AS phi0, theta AS theta0 FROM {cells}), range({-refine}, {refine + 1}) a(x), range({-refine}, {refine + 1}) b(x))
  WHERE abs(i) < {fine} AND abs(j) < {fine} AND (i <> -j OR (i = 0 AND j = 0))),
{name}_rec2 AS (
  SELECT {_keys(keys, 'p.')}p.phi0, p.theta0, p.phi, p.theta, s.t,
         CASE WHEN s.d IS NULL THEN 0.0 ELSE s.d - p.phi * 0.0 - p.theta * 0.0 END AS e,
         coalesce(s.d, 0.0) AS dlag,
         CASE WHEN s.d IS NULL THEN 0.0
              ELSE (s.d - p.phi * 0.0 - p.theta * 0.0) * (s.d - p.phi * 0.0 - p.theta * 0.0) END AS sse
  FROM {name}_diff s JOIN {name}_points p ON {on}s.t = 1
  UNION ALL
  SELECT {_keys(keys, 'r.')}r.phi0, r.theta0, r.phi, r.theta, s.t,
         CASE WHEN s.d IS NULL THEN 0.0 ELSE s.d - r.phi * r.dlag - r.theta * r.e END,
         coalesce(s.d, 0.0),
         CASE WHEN s.d IS NULL THEN r.sse
              ELSE r.sse + (s.d - r.phi * r.dlag - r.theta * r.e) * (s.d - r.phi * r.dlag - r.theta * r.e) END
  FROM {name}_rec2 r JOIN {name}_diff s ON {on_r}s.t = r.t + 1)"""


def fit_ctes(name: str, series: str, keys: list[str], grain: str,
             denominator: int = C.GRID_DENOMINATOR) -> str:
    """``{name}_fit``(keys, phi, theta, sse, n_obs, last_y, last_d, last_e, data_start, data_end)."""
    kk = _keys(keys)
    part = ("PARTITION BY " + ", ".join(f"r.{k}" for k in keys)) if keys else ""
    on = _on(keys, "r", "m")
    on = (on + " AND ") if on else ""
    on2 = _on(keys, "b", "m")
    on2 = (" AND " + on2) if on2 else ""
    return arima_ctes(name, series, keys, denominator) + f""",
{name}_meta AS (
  SELECT {kk}count(*) AS n_obs, max(t) AS mt, min({grain}) AS data_start, max({grain}) AS data_end,
         arg_max(y, t) FILTER (WHERE y IS NOT NULL) AS last_y
  FROM {series} {('GROUP BY ' + ', '.join(keys)) if keys else ''}),
{name}_cell AS (
  SELECT * FROM (
    SELECT {_keys(keys, 'r.')}r.phi, r.theta,
           row_number() OVER ({part} ORDER BY r.sse, abs(r.phi), abs(r.theta), r.phi, r.theta) AS rn
    FROM {name}_rec r JOIN {name}_meta m ON {on}r.t = m.mt) WHERE rn = 1),
{refine_ctes(name, f"{name}_cell", keys, denominator)},
{name}_best AS (
  SELECT * FROM (
    SELECT {_keys(keys, 'r.')}r.phi, r.theta, r.sse, r.e, r.dlag,
           row_number() OVER ({part} ORDER BY r.sse, abs(r.phi), abs(r.theta), r.phi, r.theta) AS rn
    FROM {name}_rec2 r JOIN {name}_meta m ON {on}r.t = m.mt) WHERE rn = 1),
{name}_fit AS (
  SELECT {_keys(keys, 'm.')}b.phi, b.theta, b.sse, CAST(m.n_obs AS INTEGER) AS n_obs,
         m.last_y, b.dlag AS last_d, b.e AS last_e, m.data_start, m.data_end
  FROM {name}_best b JOIN {name}_meta m ON TRUE{on2}
  WHERE m.n_obs >= 3)"""


def forecast_cte(name: str, fit: str, keys: list[str], steps: int = C.STEPS_PRECOMPUTE,
                 grain: str = "week", clip: bool = True, digits: int | None = 2) -> str:
    """``name``(keys, step, period, y_hat) in closed form."""
    raw = ("last_y + (phi * last_d + theta * last_e) * "
           "((1.0 - pow(phi, CAST(step AS DOUBLE))) / (1.0 - phi))")
    val = f"round({raw}, {digits})" if digits is not None else raw
    if clip:
        val = f"greatest(0.0, {val})"
    when = ("CAST(data_end + to_days(CAST(step * 7 AS INTEGER)) AS DATE)" if grain == "week"
            else "CAST(data_end + to_months(CAST(step AS INTEGER)) AS DATE)")
    return f"""{name} AS (
  SELECT {_keys(keys)}step, {when} AS period, {val} AS y_hat
  FROM {fit}, range(1, {steps + 1}) s(step))"""


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"
