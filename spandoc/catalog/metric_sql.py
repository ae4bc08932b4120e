"""SQL for QWK and friends (oracle side): explicit label ranks and joins instead of bit sets."""

from __future__ import annotations


def cells(name: str, source: str, keys: list[str]) -> str:
    k = "".join(f"{x}, " for x in keys)
    g = ", ".join([*keys, "t", "p"])
    return (f"{name} AS (SELECT {k}y_true AS t, y_round AS p, count(*) AS n, sum((y_true - y_clip) ** 2) AS se, "
            f"sum(abs(y_true - y_clip)) AS ae FROM {source} GROUP BY {g})")


def kappa(name: str, source: str, keys: list[str], guard: bool = False) -> str:
    """CTE ``name``: keys, n, qwk, rmse, mae, exact_accuracy, adjacent_accuracy (if se/ae exist in source)."""
    k = "".join(f"{x}, " for x in keys)
    ck = "".join(f"c.{x}, " for x in keys)
    on = " AND ".join(f"c.{x} IS NOT DISTINCT FROM {{a}}.{x}" for x in keys) or "true"
    group = f"GROUP BY {', '.join('c.' + x for x in keys)}" if keys else ""
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    null = "count(DISTINCT c.t) < 2 OR sum(c.n) < 2 OR " if guard else ""
    num = "CAST(sum(c.n) AS DOUBLE) * CAST(sum(c.n * (a.r - b.r) * (a.r - b.r)) AS DOUBLE)"
    den = ("(CAST(sum(c.n) AS DOUBLE) * CAST(sum(c.n * a.r * a.r) + sum(c.n * b.r * b.r) AS DOUBLE) "
           "- 2.0e0 * CAST(sum(c.n * a.r) AS DOUBLE) * CAST(sum(c.n * b.r) AS DOUBLE))")
    return f"""{name}_l AS (SELECT {k}v, row_number() OVER ({part} ORDER BY v) - 1 AS r
  FROM (SELECT {k}t AS v FROM {source} UNION SELECT {k}p FROM {source})),
{name} AS (SELECT {ck}CAST(sum(c.n) AS BIGINT) AS n,
    CASE WHEN {null}{den} = 0 THEN NULL ELSE 1.0e0 - {num} / {den} END AS qwk,
    {{extra}}
  FROM {source} c JOIN {name}_l a ON {on.format(a='a')} AND a.v = c.t JOIN {name}_l b ON {on.format(a='b')} AND b.v = c.p {group})""".replace(
        "{extra}", "0 AS dummy")


def full(name: str, source: str, keys: list[str]) -> str:
    extra = ("sqrt(sum(c.se) / sum(c.n)) AS rmse, sum(c.ae) / sum(c.n) AS mae, "
             "sum(CASE WHEN c.t = c.p THEN c.n ELSE 0 END) / sum(c.n) AS exact_accuracy, "
             "sum(CASE WHEN abs(c.t - c.p) <= 1 THEN c.n ELSE 0 END) / sum(c.n) AS adjacent_accuracy")
    return kappa(name, source, keys).replace("0 AS dummy", extra)


ROUNDED = "round(qwk, 9) AS qwk, round(rmse, 9) AS rmse, round(mae, 9) AS mae, round(exact_accuracy, 9) AS exact_accuracy, round(adjacent_accuracy, 9) AS adjacent_accuracy"


def bootstrap(name: str, conditions: list[str], replicates: int, seeds: list[int], source: str = "rounded") -> str:
    """CTEs giving ``name``: (seed, rep, diff) by keyed row draws over joint cells."""
    ps = [f"p{i}" for i in range(len(conditions))]
    pick = ", ".join(f"max(y_round) FILTER (condition = '{c}') AS p{i}" for i, c in enumerate(conditions))
    cols = ", ".join(ps)
    alive = " AND ".join(f"{p} IS NOT NULL" for p in ps)
    seed_rows = ", ".join(f"({s})" for s in seeds)
    sides = " UNION ALL ".join(f"SELECT seed, rep, {i} AS side, t, p{i} AS p, n FROM {name}_d" for i in range(len(ps)))
    return f"""{name}_c AS (SELECT *, sum(n) OVER (ORDER BY t, {cols} ROWS UNBOUNDED PRECEDING) AS hi FROM
  (SELECT t, {cols}, count(*) AS n FROM (SELECT entity_id, y_true AS t, {pick} FROM {source} GROUP BY entity_id, y_true) WHERE {alive} GROUP BY t, {cols})),
{name}_n AS (SELECT CAST(sum(n) AS BIGINT) AS nn FROM {name}_c),
{name}_i AS (SELECT seed, rep, CAST(('0x' || substr(md5('seed|' || seed || '|' || rep || '|' || i), 1, 15)) AS BIGINT) % nn AS idx
  FROM (VALUES {seed_rows}) s(seed), (SELECT unnest(range({replicates})) AS rep) r, (SELECT nn, unnest(range(nn)) AS i FROM {name}_n) x),
{name}_d AS (SELECT seed, rep, t, {cols}, count(*) AS n FROM {name}_i JOIN {name}_c ON idx >= hi - n AND idx < hi GROUP BY ALL),
{name}_f AS (SELECT seed, rep, side, t, p, sum(n) AS n FROM ({sides}) GROUP BY ALL),
{kappa(name + '_q', name + '_f', ['seed', 'rep', 'side'])},
{name} AS (SELECT seed, rep, max(qwk) FILTER (side = 0) - avg(qwk) FILTER (side > 0) AS diff FROM {name}_q GROUP BY seed, rep)"""


def summary(name: str, digits: int = 9) -> str:
    return (f"SELECT CAST(seed AS BIGINT) AS seed, round(avg(diff), {digits}) AS qwk_diff_mean, round(quantile_cont(diff, 0.025), {digits}) AS ci_lower, "
            f"round(quantile_cont(diff, 0.975), {digits}) AS ci_upper, round(avg(CASE WHEN diff > 0 THEN 1.0e0 ELSE 0 END), {digits}) AS p_positive FROM {name} GROUP BY seed")
