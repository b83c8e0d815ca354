"""Shared DuckDB fragments: the long-form statement of the array operators."""

from ..operators.perturb import ALPHAS, SEED
from .tables import SQL_SIGNALS, sql_normal, sql_uniform

FAMILIES = ("p08", "p09", "p10", "p11", "p12")
NONAXIS = ("p08", "p09", "p10")


def values(name: str, column: str, items, cast: str) -> str:
    body = ", ".join(f"({i!r})" for i in items)
    return f"{name} AS (SELECT v::{cast} AS {column} FROM (VALUES {body}) t(v))"


def conditions(perturbations, alphas=ALPHAS) -> str:
    return (
        values("c_p", "perturbation_id", perturbations, "VARCHAR")
        + ",\n"
        + values("c_a", "alpha", [a for a in alphas if a > 0], "DOUBLE")
        + ",\ncond AS (SELECT perturbation_id, alpha FROM c_p, c_a)"
    )


def key(*parts: str) -> str:
    return " || '|' || ".join(parts)


def _k(op: str, *cols: str) -> str:
    return key(f"'{SEED}|{op}'", *cols)


SQL_STATE = f"""
st AS MATERIALIZED (
  SELECT signal_id, sqrt(sum(y * y) / count(*)) AS rms, min(x) AS lo, max(x) AS hi,
         2 + floor({sql_uniform(_k('p08deg', 'signal_id'))} * 3)::BIGINT AS deg,
         {sql_normal(_k('p08', 'signal_id', '2'))} AS c2,
         {sql_normal(_k('p08', 'signal_id', '3'))} AS c3,
         {sql_normal(_k('p08', 'signal_id', '4'))} AS c4
  FROM sig GROUP BY signal_id
),
z AS MATERIALIZED (
  SELECT s.*, {sql_normal(_k('p09', 's.signal_id', 's.i'))} AS z9,
         {sql_normal(_k('p10', 's.signal_id', 's.i'))} AS z10,
         st.rms, st.lo, st.hi,
         st.c2 * (3*u*u - 1) / 2 + CASE WHEN deg >= 3 THEN st.c3 * (5*u*u*u - 3*u) / 2 ELSE 0 END
         + CASE WHEN deg >= 4 THEN st.c4 * (35*u*u*u*u - 30*u*u + 3) / 8 ELSE 0 END AS leg
  FROM (SELECT s.*, -1 + 2 * (s.x - st.lo) / (st.hi - st.lo) AS u FROM sig s JOIN st USING (signal_id)) s
  JOIN st USING (signal_id)
),
ax AS (SELECT DISTINCT i, x FROM sig),
kw AS (SELECT a.i, b.i AS j, exp(-0.5 * ((a.x - b.x) / 20.0) * ((a.x - b.x) / 20.0)) AS w FROM ax a, ax b),
kn AS MATERIALIZED (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM kw),
cz AS (SELECT z.signal_id, kn.i, sum(kn.w * z.z10) AS v FROM z JOIN kn ON kn.j = z.i GROUP BY ALL),
c1 AS (SELECT signal_id, i, v - avg(v) OVER (PARTITION BY signal_id) AS v FROM cz),
c2 AS (SELECT signal_id, i, v / sqrt(avg(v * v) OVER (PARTITION BY signal_id)) AS corr FROM c1),
d1 AS (SELECT signal_id, i, leg - avg(leg) OVER (PARTITION BY signal_id) AS v FROM z),
d2 AS (SELECT signal_id, i, v / sqrt(avg(v * v) OVER (PARTITION BY signal_id)) AS drift FROM d1)"""

SQL_PERT = """
pert AS MATERIALIZED (
  SELECT z.signal_id, z.class_id, z.group_id, c.perturbation_id, c.alpha, z.i, z.n, z.x AS rx, z.y AS ry,
    CASE c.perturbation_id WHEN 'p11' THEN z.x + 4 * c.alpha
      WHEN 'p12' THEN z.x + 4 * c.alpha * ((z.x - z.lo) / (z.hi - z.lo)) * ((z.x - z.lo) / (z.hi - z.lo))
      ELSE z.x END AS x,
    CASE c.perturbation_id WHEN 'p08' THEN z.y + c.alpha * z.rms * d2.drift
      WHEN 'p09' THEN z.y + c.alpha * z.rms * z.z9
      WHEN 'p10' THEN z.y + c.alpha * z.rms * c2.corr ELSE z.y END AS y
  FROM z JOIN c2 USING (signal_id, i) JOIN d2 USING (signal_id, i) CROSS JOIN cond c
)"""


def perturbed(perturbations=FAMILIES, alphas=ALPHAS) -> str:
    return ",".join([SQL_SIGNALS, conditions(perturbations, alphas), SQL_STATE, SQL_PERT])


def sql_width(x: str, part: str) -> str:
    """Trapezoid width of a node as a window expression."""
    w = f"OVER (PARTITION BY {part} ORDER BY {x})"
    return f"((coalesce(lead({x}) {w}, {x}) - coalesce(lag({x}) {w}, {x})) / 2)"


def sql_peaks(source: str, part: str, threshold: str, name: str = "pk") -> str:
    """Peak list of long-form ``source(part.., i, x, y)`` as CTE ``name``.

    ``threshold`` is an expression over the per-signal columns ymin, ymax,
    q01 and q99.
    """
    cols = ", ".join(f"a.{c.strip()}" for c in part.split(","))
    bare = part
    return f"""
{name}_n AS MATERIALIZED (
  SELECT {bare}, i, x, y, lag(y) OVER w AS yl, lead(y) OVER w AS yr FROM {source}
  WINDOW w AS (PARTITION BY {bare} ORDER BY i)
),
{name}_s AS (SELECT {bare}, min(y) AS ymin, max(y) AS ymax, quantile_cont(y, 0.01) AS q01,
             quantile_cont(y, 0.99) AS q99, list(y ORDER BY i) AS ys, list(x ORDER BY i) AS xs,
             count(*)::BIGINT AS n FROM {source} GROUP BY {bare}),
{name}_m AS (
  SELECT {cols}, a.i, a.y, s.ys, s.xs, {threshold} AS thr,
    coalesce(list_max(list_filter(range(1, a.i), lambda j: s.ys[j] > a.y)), 0) AS l,
    coalesce(list_min(list_filter(range(a.i + 1, s.n + 1), lambda j: s.ys[j] > a.y)), s.n + 1) AS r
  FROM {name}_n a JOIN {name}_s s USING ({bare}) WHERE a.y > a.yl AND a.y > a.yr
),
{name}_p AS (
  SELECT *, greatest(list_min(ys[l + 1:i]), list_min(ys[i:r - 1])) AS contour FROM {name}_m
),
{name}_b AS (
  SELECT *, y - contour AS prom, y - 0.5 * (y - contour) AS half FROM {name}_p WHERE y - contour >= thr
),
{name}_c AS (
  SELECT *, list_max(list_filter(range(1, i), lambda j: ys[j] <= half)) AS hl,
    list_min(list_filter(range(i + 1, len(ys) + 1), lambda j: ys[j] <= half)) AS hr,
    list_max(list_filter(range(1, i), lambda j: ys[j] <= contour)) AS al,
    list_min(list_filter(range(i + 1, len(ys) + 1), lambda j: ys[j] <= contour)) AS ar
  FROM {name}_b
),
{name} AS MATERIALIZED (
  SELECT {bare}, i AS idx, xs[i] AS pos, y AS height, prom,
    (xs[hr] + (half - ys[hr]) / (ys[hr - 1] - ys[hr]) * (xs[hr - 1] - xs[hr]))
    - (xs[hl] + (half - ys[hl]) / (ys[hl + 1] - ys[hl]) * (xs[hl + 1] - xs[hl])) AS fwhm,
    coalesce(list_sum(list_transform(range(al + 1, ar - 1), lambda j:
      (xs[j + 1] - xs[j]) * (ys[j] + ys[j + 1] - 2 * contour) / 2)), 0)
    + (xs[al + 1] - (xs[al] + (contour - ys[al]) / (ys[al + 1] - ys[al]) * (xs[al + 1] - xs[al])))
      * (ys[al + 1] - contour) / 2
    + ((xs[ar] + (contour - ys[ar]) / (ys[ar - 1] - ys[ar]) * (xs[ar - 1] - xs[ar])) - xs[ar - 1])
      * (ys[ar - 1] - contour) / 2 AS area,
    row_number() OVER (PARTITION BY {bare} ORDER BY i) AS ord,
    row_number() OVER (PARTITION BY {bare} ORDER BY prom, xs[i]) AS rank
  FROM {name}_c
)"""


def sql_match(left: str, right: str, part: str, tolerance: str, name: str, extra: str = "") -> str:
    """Greedy one-to-one matches as rows ``(part.., l, r, d)`` in CTE ``name``.

    ``extra`` is an optional ``FROM`` item with more grouping columns that the
    tolerance may use.
    """
    return f"""
{name}_c AS (
  SELECT {part}, a.ord AS l, b.ord AS r, abs(b.pos - a.pos) AS d
  FROM {left} a JOIN {right} b USING ({part}) WHERE abs(b.pos - a.pos) <= {tolerance}
),
{name}_l AS (SELECT {part}, list([{{'l': l, 'r': r, 'd': d}}] ORDER BY d, l, r) AS c FROM {name}_c GROUP BY {part}),
{name}_r AS (
  SELECT {part}, list_reduce(c, lambda acc, p:
    CASE WHEN len(list_filter(acc, lambda m: m.l = p[1].l OR m.r = p[1].r)) = 0
    THEN list_concat(acc, p) ELSE acc END) AS m FROM {name}_l
),
{name} AS (SELECT {part}, u.l, u.r, u.d FROM (SELECT {part}, unnest(m) AS u FROM {name}_r))"""
