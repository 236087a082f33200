"""Independent ANSI-SQL (DuckDB dialect) statements for the correctness gate.

Each statement recomputes one operator from the raw tables (``orders``,
``lineitem``) so that the Spark plan and the SQL text share nothing but the
definitions.  Only the panel CTE is common to all of them.
"""

from __future__ import annotations

from . import config as C

LAG_DAYS = (1, 3, 7, 14)


def _avg(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,6))) AS DOUBLE) / count({x})"


def _lag_mean(x: str, n: int) -> str:
    w = f"(PARTITION BY site ORDER BY _day RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return (f"CAST(sum(CAST({x} AS DECIMAL(28,12))) OVER {w} AS DOUBLE)"
            f" / nullif(count({x}) OVER {w}, 0)")


def _lag_sum(x: str, n: int) -> str:
    w = f"(PARTITION BY site ORDER BY _day RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CAST(sum(CAST({x} AS DECIMAL(28,12))) OVER {w} AS DOUBLE)"


def panel_cte() -> str:
    lags = []
    for n in LAG_DAYS:
        lags += [f"{_lag_mean('TA', n)} AS TA_lag{n}d",
                 f"{_lag_mean('TS_10cm', n)} AS TS_lag{n}d",
                 f"{_lag_mean('SWC_10cm', n)} AS SWC_lag{n}d",
                 f"{_lag_sum('precipitation_rate', n)} AS P_lag{n}d"]
    lag_sql = ",\n  ".join(lags)
    return f"""
daily AS (
  SELECT o.o_orderstatus AS site, CAST(o.o_orderdate AS DATE) AS Date,
    {_avg('l.l_quantity * (1 - l.l_discount)')} - ({_avg('l.l_extendedprice')}) / 5e3 - 14e0 AS NEE_U50_f,
    1e2 * ({_avg("CASE WHEN l.l_returnflag = 'R' THEN 1e0 ELSE 0e0 END")}) AS Snow_Cover_Percentage,
    CAST(count(DISTINCT l.l_suppkey) AS DOUBLE) AS D_SNOW,
    median(l.l_discount) AS NDVI_nonSR_Median,
    max(l.l_discount) AS NDVI_nonSR_Max,
    1e2 * ({_avg('l.l_tax')}) AS RH,
    1e2 * ({_avg('l.l_discount')}) AS TA,
    1e2 * min(l.l_discount) AS TA_min,
    1e2 * max(l.l_discount) AS TA_max,
    ({_avg('l.l_extendedprice')}) / 1e3 AS RG,
    min(l.l_extendedprice) / 1e3 AS RG_min,
    max(l.l_extendedprice) / 1e3 AS RG_max,
    stddev_samp(l.l_extendedprice) / 1e3 AS VPD_f,
    CAST(sum(CAST(l.l_quantity AS DECIMAL(18,6))) AS DOUBLE) AS precipitation_rate,
    {_avg('l.l_quantity')} AS SWC_10cm,
    max(o.o_totalprice) / 1e3 AS TS_10cm
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  GROUP BY 1, 2
),
daily_n AS (SELECT *, date_diff('day', DATE '1970-01-01', Date) AS _day FROM daily),
panel AS (
  SELECT * EXCLUDE (_day),
  CAST(date_diff('day', lag(Date) OVER (PARTITION BY site ORDER BY _day), Date) AS DOUBLE) AS DSSM,
  {lag_sql}
  FROM daily_n
)"""


def prepared_cte(features, name: str = "prep", source: str = "panel",
                 season: bool = False) -> str:
    """Panel + seasonal angle + date parts, complete on target and features."""
    conds = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in [C.TARGET] + list(features))
    season_sql = " AND month(Date) BETWEEN 6 AND 10" if season else ""
    return f"""
{name}_base AS (
  SELECT *, sin(2 * pi() * dayofyear(Date) / 365) AS sin_doy,
            cos(2 * pi() * dayofyear(Date) / 365) AS cos_doy,
            CAST(year(Date) AS INTEGER) AS Year, CAST(month(Date) AS INTEGER) AS Month,
            CAST(dayofyear(Date) AS INTEGER) AS DOY
  FROM {source}
),
{name} AS (SELECT * FROM {name}_base WHERE {conds}{season_sql})"""


def split_cte(name: str = "split", source: str = "panel") -> str:
    """Exact year-stratified 80/20 split keyed on (site, Date)."""
    return f"""
{name}_keys AS (
  SELECT site, Date, CAST(year(Date) AS INTEGER) AS Year,
         md5('42|' || site || '|' || CAST(Date AS VARCHAR)) AS _h
  FROM {source} WHERE {C.TARGET} IS NOT NULL AND NOT isnan({C.TARGET})
),
{name}_years AS (
  SELECT site, Year, count(*) AS n_y FROM {name}_keys GROUP BY 1, 2
),
{name}_sites AS (
  SELECT site, sum(n_y) AS n_site, (sum(n_y) + 4) // 5 AS n_test FROM {name}_years GROUP BY 1
),
{name}_alloc AS (
  SELECT y.site, y.Year, y.n_y,
         (s.n_test * y.n_y) // s.n_site AS q_floor,
         (s.n_test * y.n_y) % s.n_site AS q_rem,
         s.n_test - sum((s.n_test * y.n_y) // s.n_site) OVER (PARTITION BY y.site) AS deficit,
         row_number() OVER (PARTITION BY y.site ORDER BY (s.n_test * y.n_y) % s.n_site DESC, y.Year) AS rem_rank
  FROM {name}_years y JOIN {name}_sites s USING (site)
),
{name}_quota AS (
  SELECT site, Year, q_floor + CASE WHEN rem_rank <= deficit THEN 1 ELSE 0 END AS quota FROM {name}_alloc
),
{name} AS (
  SELECT k.site, k.Date,
         CASE WHEN row_number() OVER (PARTITION BY k.site, k.Year ORDER BY k._h) <= q.quota
              THEN 'test' ELSE 'train' END AS split
  FROM {name}_keys k JOIN {name}_quota q USING (site, Year)
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes)


def standin_ctes(features=tuple(C.S12), season: bool = False) -> str:
    """panel -> split -> prepared -> prep_split -> standin (all sites)."""
    from .operators.standin import standin_sql
    return with_(
        panel_cte(), split_cte(), prepared_cte(features, season=season),
        "prep_split AS (SELECT p.*, s.split FROM prep p JOIN split s USING (site, Date))",
        standin_sql(list(features), C.TARGET, "prep_split"),
    )
