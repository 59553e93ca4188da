"""SQL forms of the clustering queries: points, pairs, grids and labels as common table expressions."""

from __future__ import annotations

POINTS = {
    "e64": ("select vec_id::bigint as id, list_transform(embedding, lambda x: x::double) as v from embeddings", 64),
    "e4": ("select vec_id::bigint as id, list_transform(list_slice(embedding, 1, 4), lambda x: x::double) as v from embeddings", 4),
    "e2": ("select vec_id::bigint as id, list_transform(list_slice(embedding, 1, 2), lambda x: x::double) as v from embeddings", 2),
    "c1": ("select c_custkey::bigint as id, [c_acctbal::double] as v from customer", 1),
    "p2": ("""select p_partkey::bigint as id, [(p_size - a) / (b - a)::double, (p_retailprice - c) / (d - c)] as v
  from part, (select min(p_size) as a, max(p_size) as b, min(p_retailprice) as c, max(p_retailprice) as d from part)""", 2),
}


def distance(d: int, a: str = "a.v", b: str = "b.v") -> str:
    if d <= 4:
        return " + ".join(f"({a}[{k}] - {b}[{k}]) * ({a}[{k}] - {b}[{k}])" for k in range(1, d + 1))
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def pairs(name: str, eps: list[float]) -> str:
    """with pts, prs(i, j, d2, code)"""
    sql, d = POINTS[name]
    code = " ".join(f"when d2 <= {e!r}::double * {e!r}::double then {k}" for k, e in enumerate(eps))
    return f"""with recursive pts as materialized ({sql}),
raw as materialized (select a.id as i, b.id as j, {distance(d)} as d2 from pts a join pts b on a.id < b.id),
prs as materialized (select i, j, d2, case {code} end as code from raw where d2 <= {eps[-1]!r}::double * {eps[-1]!r}::double)"""


def grid(name: str, eps: list[float], min_pts: list[int]) -> str:
    """... cfg, deg(config, id, degree), core, root(config, id, root), member(config, id, root, is_core), lab(config, id, label, is_core)"""
    cfg = ", ".join(f"({k * len(min_pts) + m}, {k}, {e!r}::double, {p})" for k, e in enumerate(eps) for m, p in enumerate(min_pts))
    return f"""{pairs(name, eps)},
cfg as (select * from (values {cfg}) t(config, eps_idx, eps, min_pts)),
both_ends as materialized (select i as a, j as b, code from prs union all select j, i, code from prs),
deg as materialized (select config, eps_idx, min_pts, id, 1 + count(b) as degree from cfg cross join pts left join both_ends on a = id and code <= eps_idx group by all),
core as materialized (select config, eps_idx, id from deg where degree >= min_pts),
reach(config, eps_idx, src, dst) as (
  select config, eps_idx, id, id from core
  union
  select r.config, r.eps_idx, r.src, e.b from reach r join both_ends e on e.a = r.dst and e.code <= r.eps_idx join core c on c.config = r.config and c.id = e.b
),
root as materialized (select config, eps_idx, src as id, min(dst) as root from reach group by all),
beside as materialized (select d.config, d.id, r.root from deg d join both_ends e on e.a = d.id and e.code <= d.eps_idx join root r on r.config = d.config and r.id = e.b where d.degree < d.min_pts),
member as materialized (select config, id, root, true as is_core from root union all select config, id, min(root), false from beside group by config, id),
named as (select config, root, dense_rank() over (partition by config order by min(id)) - 1 as label from member group by config, root),
lab as materialized (select d.config, d.id, coalesce(n.label, -1)::int as label, coalesce(m.is_core, false) as is_core
  from deg d left join member m on m.config = d.config and m.id = d.id left join named n on n.config = m.config and n.root = m.root)"""


#: Measurements that the events stand for: cases, blocks and methods by event number.
RECORDS = """with rec as (
  select 'c' || (event_id % 20) as case_id, ((event_id // 20) % 6)::int as block,
    ['multi', 'sequential', 'baseline'][((event_id // 120) % 3 + 1)::int] as method, 10 + avg(abs(value)) as fit_ms
  from events group by all)"""
