"""Registry of named queries and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6


def tidy(df: DataFrame) -> DataFrame:
    """Integers as bigint and doubles rounded, so both engines print the same values."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        if kind in ("integer", "short", "byte"):
            c = c.cast("bigint")
        elif kind in ("double", "float"):
            c = F.round(c.cast("double"), DIGITS)
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its SQL twin."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(prepare(spark), sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = with_views(sql)
        return fn

    return register


# Views of the SQL twins, in dependency order; the same definitions as metricloom.sources.tables.
VIEWS: dict[str, str] = {
    "points": """
        SELECT *, strlen(line) AS line_length FROM (
          SELECT *, sha1(metric || '|' || CASE WHEN env IS NULL THEN 'k' ELSE 'env,k' END) AS family_id,
            sha1(metric || '|' || source || '|' || coalesce('env=' || env || ',', '') || 'k=' || k) AS series_id,
            CASE WHEN is_delta THEN '"∆' || metric || '"' ELSE metric END || ' ' || CAST(value AS VARCHAR) || ' ' || ts
              || ' source=' || source || coalesce(' env=' || env, '') || ' k=' || k AS line
          FROM (
            SELECT event_id AS row_id, 'app.' || event_type AS metric, value,
              CAST(floor(epoch(ts)) AS BIGINT) AS ts, 'user-' || user_id AS source,
              json_extract_string(props, '$.k') AS k,
              CASE event_id % 6 WHEN 0 THEN 'prod' WHEN 2 THEN 'staging' WHEN 4 THEN 'dev' END AS env,
              event_type = 'click' AS is_delta
            FROM events))""",
    "ptags": """
        SELECT family_id, row_id, metric, ts, 'k' AS key, k AS value FROM points
        UNION ALL SELECT family_id, row_id, metric, ts, 'env', env FROM points WHERE env IS NOT NULL""",
    "dims": """
        SELECT family_id, row_id, ts, 'source' AS dim, source AS value FROM points
        UNION ALL SELECT family_id, row_id, ts, 'tag:' || key, value FROM ptags""",
    "sales": """
        SELECT *, sha1('sales.price|linestatus,returnflag') AS family_id,
          'sales.price ' || CAST(value AS VARCHAR) || ' ' || ts || ' source=' || source
            || ' linestatus=' || linestatus || ' returnflag=' || returnflag AS line
        FROM (
          SELECT l_orderkey || '-' || l_linenumber AS row_id, l_extendedprice AS value,
            CAST(epoch(l_shipdate) AS BIGINT) + 946684800 AS ts, 'supp-' || l_suppkey AS source,
            l_returnflag AS returnflag, l_linestatus AS linestatus FROM lineitem)""",
    "spans": """
        SELECT *, sha1('span|' || operation) AS family_id,
          operation || ' source=' || source || ' priority='
            || CASE WHEN priority LIKE '% %' THEN '"' || priority || '"' ELSE priority END
            || ' ' || start_ms || ' ' || duration_ms AS line
        FROM (
          SELECT o_orderkey AS row_id, 'order.' || o_orderstatus AS operation, 'cust-' || o_custkey AS source,
            o_orderpriority AS priority, CAST(epoch(o_orderdate) AS BIGINT) * 1000 AS start_ms,
            CAST(floor(o_totalprice) AS BIGINT) AS duration_ms FROM orders)""",
    "hcent": """
        SELECT 'flag-' || l_returnflag AS source,
          CAST(epoch(l_shipdate) AS BIGINT) // 86400 * 86400 + 946684800 AS ts,
          l_quantity AS v, count(*) AS n
        FROM lineitem GROUP BY ALL""",
    "hists": """
        SELECT source, ts, CAST(sum(n) AS BIGINT) AS hist_count, count(*) AS centroids,
          sha1('sales.quantity|') AS family_id,
          '!D ' || ts || string_agg(' #' || n || ' ' || CAST(v AS VARCHAR), '' ORDER BY v) || ' sales.quantity source=' || source AS line,
          '!D ' || ts || ' #' || CAST(sum(n) AS BIGINT) || string_agg(' ' || n || ' ' || CAST(v AS VARCHAR), '' ORDER BY v) AS header
        FROM hcent GROUP BY source, ts""",
    "alllines": """
        SELECT line, 'metric' AS kind FROM points UNION ALL SELECT line, 'metric' FROM sales
        UNION ALL SELECT line, 'span' FROM spans UNION ALL SELECT line, 'histogram' FROM hists""",
    "badlines": r"""
        SELECT row_id, mode, metric,
          CASE mode WHEN 0 THEN replace(line, metric, 'invalid metric name')
            WHEN 1 THEN regexp_replace(line, 'source=\S+', '', 'g')
            WHEN 2 THEN regexp_replace(line, '\s-?\d+\.?\d*\s', ' NaN ', 'g')
            WHEN 3 THEN substr(line, 1, length(line) // 2)
            WHEN 4 THEN regexp_replace(line, '^([^=]*)=', '\1==')
            ELSE line END AS value
        FROM (SELECT *, CASE WHEN u_error < 0.5 THEN CAST(floor(u_mode * 5) AS BIGINT) END AS mode FROM (
          SELECT *, ('0x' || substr(md5('7|' || row_id || '|error'), 1, 13))::UBIGINT / 4503599627370496.0 AS u_error,
            ('0x' || substr(md5('7|' || row_id || '|mode'), 1, 13))::UBIGINT / 4503599627370496.0 AS u_mode
          FROM points))""",
    "badparsed": r"""
        SELECT *, CASE
            WHEN len(tok) < 3 THEN 'too_few_fields'
            WHEN regexp_replace(array_to_string(tok, ''), '\s+', '', 'g') <> regexp_replace(value, '\s+', '', 'g')
              OR NOT regexp_full_match(tok[1], '[∆Δ]?[A-Za-z0-9][A-Za-z0-9._-]*|"([^"\\]|\\.)+"') THEN 'bad_name'
            WHEN NOT regexp_full_match(tok[2], '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN 'invalid_value'
            WHEN len(list_filter(tg, lambda t: t LIKE 'source=%' OR t LIKE 'host=%')) = 0 THEN 'missing_source'
            WHEN len(list_filter(tg, lambda t: NOT regexp_full_match(t, '[A-Za-z0-9._/-]+=([^="][^"]*|"([^"\\]|\\.)+")'))) > 0 THEN 'invalid_tag'
          END AS drop_reason
        FROM (SELECT *, CASE WHEN regexp_full_match(coalesce(tok[3], ''), '\d{10}') THEN tok[4:] ELSE tok[3:] END AS tg
          FROM (SELECT *, regexp_extract_all(value, '(?:[^\s"]|"(?:[^"\\]|\\.)*")+') AS tok FROM badlines))""",
    "famcounts": "SELECT family_id, metric, count(*) AS n FROM points GROUP BY ALL",
    "dimcounts": "SELECT family_id, dim, value, count(*) AS n FROM dims GROUP BY ALL",
    "minutes": "SELECT family_id, ts // 60 * 60 AS minute, count(*) AS n FROM points GROUP BY ALL",
    "quantiles": """
        SELECT family_id, quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.05) AS p05,
          quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99
        FROM points GROUP BY family_id""",
    "refs": "SELECT * FROM points WHERE ts < epoch(TIMESTAMP '2024-01-16')",
    "curs": "SELECT * FROM points WHERE ts >= epoch(TIMESTAMP '2024-01-16')",
    "rdims": """
        SELECT family_id, dim, value, count(*) AS n, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY family_id, dim) AS p
        FROM dims WHERE ts < epoch(TIMESTAMP '2024-01-16') GROUP BY family_id, dim, value""",
    "cdims": """
        SELECT family_id, dim, value, count(*) AS n, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY family_id, dim) AS p
        FROM dims WHERE ts >= epoch(TIMESTAMP '2024-01-16') GROUP BY family_id, dim, value""",
    "aligned": """
        SELECT coalesce(a.family_id, b.family_id) AS family_id, coalesce(a.dim, b.dim) AS dim,
          coalesce(a.value, b.value) AS value, coalesce(a.p, 0) AS p, coalesce(b.p, 0) AS q
        FROM rdims a FULL JOIN cdims b ON a.family_id = b.family_id AND a.dim = b.dim AND a.value = b.value""",
    "jsdim": """
        SELECT family_id, dim, max(p) > 0 AS in_ref,
          CASE WHEN max(p) = 0 OR max(q) = 0 THEN 1.0 ELSE greatest(0.0, sum(
            CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END
            + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / (2 * ln(2))) END AS js
        FROM aligned GROUP BY family_id, dim""",
    "jsfam": """
        SELECT *, (js_source + js_tags_avg) / 2 AS js_categorical FROM (
          SELECT family_id, max(js) FILTER (dim = 'source') AS js_source,
            coalesce(avg(js) FILTER (dim LIKE 'tag:%' AND in_ref), 0) AS js_tags_avg
          FROM jsdim GROUP BY family_id)""",
    "rq": """
        SELECT family_id, quantile_cont(value, [0.01, 0.05, 0.5, 0.95, 0.99]) AS v,
          quantile_cont(line_length, [0.01, 0.05, 0.5, 0.95, 0.99]) AS s FROM refs GROUP BY family_id""",
    "cq": "SELECT family_id, quantile_cont(value, [0.01, 0.05, 0.5, 0.95, 0.99]) AS v FROM curs GROUP BY family_id",
    "wass": """
        SELECT rq.family_id, CASE WHEN cq.v IS NULL THEN 1.0 ELSE
          (abs(rq.v[1] - cq.v[1]) + abs(rq.v[2] - cq.v[2]) + abs(rq.v[3] - cq.v[3]) + abs(rq.v[4] - cq.v[4]) + abs(rq.v[5] - cq.v[5])) / 5
          / CASE WHEN rq.v[5] > rq.v[1] THEN rq.v[5] - rq.v[1] ELSE 1 END END AS wasserstein
        FROM rq LEFT JOIN cq USING (family_id)""",
    "ksfam": """
        SELECT rq.family_id, coalesce(greatest(0.0, max(greatest(p - f_at, f_below - p))), 1.0) AS ks_size
        FROM rq LEFT JOIN (
          SELECT r.family_id, p, avg(CASE WHEN c.line_length <= r.q THEN 1.0 ELSE 0 END) AS f_at,
            avg(CASE WHEN c.line_length < r.q THEN 1.0 ELSE 0 END) AS f_below
          FROM (SELECT family_id, unnest(s) AS q, unnest([0.01, 0.05, 0.5, 0.95, 0.99]) AS p FROM rq) r
          JOIN curs c ON c.family_id = r.family_id GROUP BY r.family_id, p, r.q) k ON k.family_id = rq.family_id
        GROUP BY rq.family_id""",
    "scores": """
        SELECT family_id, n, CASE WHEN n >= 10 THEN js_source END AS js_source, CASE WHEN n >= 10 THEN js_tags_avg END AS js_tags_avg,
          CASE WHEN n >= 10 THEN js_categorical END AS js_categorical, CASE WHEN n >= 10 THEN wasserstein END AS wasserstein, CASE WHEN n >= 10 THEN ks_size END AS ks_size,
          CASE WHEN n < 10 THEN 'insufficient'
            WHEN js_categorical > 0.05 OR coalesce(wasserstein, 0) > 0.1 OR coalesce(ks_size, 0) > 0.05 THEN 'red'
            WHEN js_categorical > 0.025 OR coalesce(wasserstein, 0) > 0.05 OR coalesce(ks_size, 0) > 0.025 THEN 'amber' ELSE 'green' END AS status
        FROM (SELECT family_id, count(*) FILTER (ts >= epoch(TIMESTAMP '2024-01-16')) AS n FROM points GROUP BY family_id)
        LEFT JOIN jsfam USING (family_id) LEFT JOIN wass USING (family_id) LEFT JOIN ksfam USING (family_id)""",
    "day": "SELECT *, ts // 86400 * 86400 AS window_start FROM points",
}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it needs, directly or through other views."""
    import re

    def names(text: str) -> set[str]:
        return {v for v in VIEWS if re.search(rf"\b{v}\b", text)}

    needed, todo = set(), names(sql)
    while todo:
        v = todo.pop()
        if v not in needed:
            needed.add(v)
            todo |= names(VIEWS[v]) - needed - {v}
    if not needed:
        return sql.strip()
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in VIEWS if v in needed)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def u(row: str, dim: str, seed: int | str = 1) -> str:
    """SQL text of the repeatable uniform draw."""
    return f"(('0x' || substr(md5('{seed}|' || {row} || '|{dim}'), 1, 13))::UBIGINT / 4503599627370496.0)"
