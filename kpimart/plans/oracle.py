"""ANSI SQL oracles (DuckDB) for the catalog queries.

They run on the driver's tables as views and are used only to check the
DataFrame-API queries of ``kpimart.plans.catalog``; the engine never runs SQL
text of its own. ``{f}`` is the sales fact, ``{e}`` the entitlement inputs.
"""

from __future__ import annotations

F_CTE = (
    "f as (select cast(year(o_orderdate) as int) as year, p_type as category, p_brand as brand, "
    "n_name as region, cast(l_extendedprice as decimal(18,2)) as sales, l_quantity as quantity, l_orderkey as id "
    "from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey "
    "join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey)"
)
E_CTE = (
    "users as (select c_custkey as user_id, case when c_custkey % 500 = 0 then 'admin' "
    "when c_custkey % 10 = 0 then 'editor' else 'viewer' end as role from customer), "
    "dashboards as (select cast(n_nationkey as bigint) as dashboard_id, n_name as name, "
    "cast(n_nationkey * 7 as bigint) as owner_id from nation), "
    "access as (select distinct o_custkey as user_id, cast(s_nationkey as bigint) as dashboard_id "
    "from orders join lineitem on o_orderkey = l_orderkey join supplier on l_suppkey = s_suppkey), "
    "eff as (select u.user_id, d.dashboard_id from users u cross join dashboards d where u.role = 'admin' "
    "union select owner_id, dashboard_id from dashboards union select user_id, dashboard_id from access), "
    "rule as (select user_id, cast(null as bigint) as dashboard_id, true as sees_all from users where role = 'admin' "
    "union all select user_id, dashboard_id, false from (select owner_id as user_id, dashboard_id from dashboards "
    "union select user_id, dashboard_id from access) x)"
)

_SQL = {
    "flt_eq": "with {f} select year, category, brand, id, quantity from f where year = 1997 and category = 'ECONOMY'",
    "flt_ops": (
        "with {f} select year, category, brand, id, quantity from f where year >= 1996 and category in "
        "('ECONOMY','PROMO') and brand <> 'Brand#1' and quantity > 49 and contains(region, 'N_1')"
    ),
    "flt_strict": "with {f} select region, count(*) as n from f where year = 1998 and brand = 'Brand#2' group by region",
    "flt_lenient": "with {f} select category, count(*) as n from f where year = 1998 group by category",
    "flt_pre_agg": (
        "with {f} select category, cast(sum(sales) as double) as total_sales from f "
        "where region = 'NATION_3' group by category"
    ),
    "flt_post_agg": (
        "with {f} select category, cast(sum(sales) as double) as total_sales from f group by category "
        "having sum(sales) > 1000000 and category <> 'PROMO'"
    ),
    "prj_chain": (
        "with {f} select id, category, quantity * 2 + 1 as q2, (quantity * 2 + 1) / 4 as q3 from f"
    ),
    "prj_broadcast": (
        "with {f} select id, category, quantity, (select max(quantity) from f) - quantity as below_max from f"
    ),
    "agg_sum": "with {f} select category, cast(sum(sales) as double) as total_sales from f group by category",
    "agg_mean": (
        "with {f} select brand, cast(sum(cast(quantity as decimal(18,2))) as double) / count(quantity) "
        "as mean_quantity from f group by brand"
    ),
    "agg_count": "with {f} select region, count(*) as count_id from f group by region",
    "agg_min_max": (
        "with {f} select category, brand, min(quantity) as min_quantity, max(quantity) as max_quantity "
        "from f group by category, brand"
    ),
    "agg_multi": (
        "with {f} select category, region, cast(sum(sales) as double) as total_sales, count(*) as n, "
        "max(quantity) as max_quantity from f group by category, region"
    ),
    "agg_global": "with {f} select cast(sum(sales) as double) as sum_sales, count(*) as count_id from f",
    "agg_global_empty": (
        "with {f} select cast(coalesce(sum(sales), 0) as double) as sum_sales, count(*) as count_id, "
        "max(quantity) as max_quantity from f where year = 2050"
    ),
    "agg_passthrough": "with {f} select year, category, brand, id from f",
    "agg_keys_only": "with {f} select distinct category, brand from f",
    "met_yoy": (
        "with {f}, a as (select category, year, sum(sales) as s from f group by category, year), "
        "b as (select category, year, cast(s as double) as sales, cast(sum(s) over (partition by category "
        "order by year range between 1 preceding and 1 preceding) as double) as prev_sales from a) "
        "select category, year, sales, prev_sales, sales / nullif(prev_sales, 0) - 1 as yoy from b"
    ),
    "met_yoy_gap": (
        "with {f}, a as (select brand, year, sum(sales) as s from f where year <> 1997 group by brand, year), "
        "b as (select brand, year, cast(s as double) as sales, cast(sum(s) over (partition by brand "
        "order by year range between 1 preceding and 1 preceding) as double) as prev_sales from a) "
        "select brand, year, sales / nullif(prev_sales, 0) - 1 as yoy from b"
    ),
    "met_share_cols": (
        "select o_orderkey as id, l_linenumber as line, l_extendedprice / nullif(o_totalprice, 0) * 100 as share "
        "from lineitem join orders on l_orderkey = o_orderkey"
    ),
    "met_share_parent": (
        "with {f}, a as (select category, brand, sum(sales) as s from f group by category, brand) "
        "select category, brand, cast(s as double) / nullif(cast(sum(s) over (partition by category) as double), 0) "
        "* 100 as share from a"
    ),
    "met_share_total": (
        "with {f}, a as (select category, sum(sales) as s from f group by category) select category, "
        "cast(s as double) as sales, cast(s as double) / cast((select sum(s) from a) as double) * 100 as share from a"
    ),
    "met_custom": (
        "with {f} select brand, cast(sum(sales) as double) / nullif(cast(sum(cast(quantity as decimal(18,2))) "
        "as double), 0) as unit_price from f group by brand"
    ),
    "met_merge": (
        "with {f}, b as (select category, year, least(greatest(cast(floor(sales) as bigint) // 1000, 0), 127) as band, count(*) as k, "
        "min(region) as r from f group by all), c as (select *, sum(k) over (partition by category, year order by band) as reached, "
        "sum(k) over (partition by category, year) as n from b) select category, year, min(band) filter (reached >= (n + 1) // 2) * 1000 "
        "as median_band, cast(max(n) as bigint) as n, min(r) as first_region from c group by category, year"
    ),
    "pip_run": (
        "with {f}, g as (select category, brand, cast(quantity * 2 as decimal(18,2)) as q2 from f where year = 1996) "
        "select category, brand, cast(sum(q2) as double) as sum_q2, count(*) as n from g group by category, brand"
    ),
    "pip_fanout": (
        "with {f} select 1 as dashboard_id, count(distinct category) as records from f union all "
        "select 2, count(distinct brand) from f union all "
        "select 3, count(*) from (select distinct category, year from f) x"
    ),
    "pip_family": (
        "with {f} select cast(n_nationkey as bigint) as dashboard_id, category, year, "
        "cast(sum(sales) as double) as total_sales, count(*) as n from f join nation on region = n_name "
        "group by n_nationkey, category, year"
    ),
    "pip_families": (
        "with {f}, s as (select cast(n_nationkey as bigint) as dashboard_id, n_name, n_nationkey % 3 as shape from nation) "
        "select dashboard_id, count(distinct category) as row_count, nullif(count(f.id), 0) as n from s left join f on region = n_name "
        "where shape = 0 group by dashboard_id union all "
        "select dashboard_id, count(distinct year), nullif(count(f.id), 0) from s left join f on region = n_name "
        "where shape = 1 group by dashboard_id union all "
        "select dashboard_id, (select count(distinct brand) from f), null from s where shape = 2"
    ),
    "pip_ranges": (
        "with {f}, m as (select n_nationkey as k, 1992 + n_nationkey % 5 as first from nation) "
        "select cast(k as bigint) as dashboard_id, category, count(*) as n, cast(sum(sales) as double) as total_sales "
        "from m join f on year >= first and year < first + 1 + k % 3 and sales > k * 1000 group by k, category"
    ),
    "pip_in_lists": (
        "with {f}, m as (select n_nationkey as k from nation) "
        "select cast(k as bigint) as dashboard_id, brand, count(*) as n from m join f "
        "on region in ('NATION_' || k, 'NATION_' || ((k + 1) % 25), 'NATION_' || ((k + k % 2) % 25)) "
        "and year in (1993, 1992 + k % 7, 1997) group by k, brand"
    ),
    "pip_family_inner": (
        "with {f}, m as (select n_nationkey as k, f.* from nation join f on region = n_name and year >= 1992 + n_nationkey % 5), "
        "w as (select *, max(sales) over (partition by k) - sales as below, sales - min(sales) over (partition by k, brand) as above from m) "
        "select cast(k as bigint) as dashboard_id, category, cast(sum(below) as double) as below, cast(sum(above) as double) as above, "
        "count(*) as n from w group by k, category"
    ),
    "str_table": (
        "with {f}, s as (select cast(n_nationkey as bigint) as dashboard_id, n_name, n_nationkey % 3 as shape from nation) "
        "select dashboard_id, count(distinct category) as row_count, nullif(count(f.id), 0) as n from s left join f on region = n_name "
        "where shape = 0 group by dashboard_id union all "
        "select dashboard_id, count(distinct year), nullif(count(f.id), 0) from s left join f on region = n_name "
        "where shape = 1 group by dashboard_id union all "
        "select dashboard_id, (select count(distinct brand) from f), null from s where shape = 2"
    ),
    "pip_trigger": (
        "with {f} select category, year, cast(sum(sales) as double) as total_sales, count(*) as n from f "
        "where region = 'NATION_3' group by category, year"
    ),
    "prj_grouped": (
        "with {f} select id, brand, quantity, max(quantity) over (partition by brand) - quantity as below_max from f"
    ),
    "prj_growth": (
        "select o_orderkey as id, l_linenumber as line, l_extendedprice / nullif(o_totalprice, 0) - 1 as growth "
        "from lineitem join orders on l_orderkey = o_orderkey"
    ),
    "snk_prune": "with {f} select brand, count(*) as n, 2 as removed from f group by brand",
    "snk_json": (
        "with {f} select category, year, cast(sum(sales) as double) as total_sales, count(*) as n from f group by category, year"
    ),
    "snk_consume": "with {f} select category, year, count(*) as n, 0 as left from f group by category, year",
    "src_admit": "with {f} select distinct region, true as admitted, true as refused from f",
    "src_validate": (
        "with {f} select upload, upload not in ('missing', 'bad') as is_valid, "
        "case when upload = 'missing' then 'Missing columns: quantity' end as error, "
        "case when upload = 'bad' then (select count(*) from f where year = 1997) else 0 end as bad_rows "
        "from (values ('plain'), ('reordered'), ('extra'), ('missing'), ('bad')) u(upload)"
    ),
    "src_reordered": (
        "with {f} select category, brand, count(*) as n, cast(sum(sales) as double) as total_sales "
        "from f group by category, brand"
    ),
    "src_headers": (
        "with {f} select category, brand, 3 * count(*) as n, cast(3 * sum(sales) as double) as total_sales, 0 as bad_files "
        "from f group by category, brand"
    ),
    "src_infer": (
        "with {f} select category, 3 * count(*) as n, 2 * count(*) as with_region, 3 * sum(quantity) + 0.5 * count(*) as quantity, "
        "'category:string,note:string,quantity:double,region:string,sales:double,year:int' as kinds from f group by category"
    ),
    "reg_transform": "with {f} select category, count(*) as n from f where sales >= 50000 group by category",
    "snk_latest": "with {f} select brand, year, count(*) as n from f group by brand, year",
    "pip_get_data": (
        "with {f} select category, year, cast(sum(sales) as double) as total_sales, count(*) as n from f "
        "where region = 'NATION_3' and year = 1998 group by category, year"
    ),
    "srt_latest": (
        "select user_id, max(ts) as created_at, max_by(event_type, (ts, event_id)) as event_type from events group by user_id"
    ),
    "src_csv": (
        "with {f} select category, brand, count(*) as n, cast(sum(sales) as double) as total_sales "
        "from f group by category, brand"
    ),
    "str_upload": "with {f} select category, year, count(*) as n from f group by category, year",
    "str_backlog": "with {f} select category, year, count(*) as n from f group by category, year",
    "str_quarantine": (
        "with {f} select category, year, count(*) as n, 2 as ok, 1 as failed, "
        "'Missing columns: [''quantity'']' as error, 0 as left from f group by category, year"
    ),
    "snk_prune_family": (
        "with {f} select cast(n_nationkey as bigint) as dashboard_id, category, year, "
        "cast(sum(sales) as double) as total_sales, count(*) as n, 2 as gone from f join nation on region = n_name "
        "group by n_nationkey, category, year"
    ),
    "ent_snapshots": (
        "with {f}, {e} select cast(n_nationkey as bigint) as dashboard_id, category, year, "
        "cast(sum(sales) as double) as total_sales, count(*) as n from f join nation on region = n_name "
        "where n_nationkey in (select dashboard_id from eff where eff.user_id = 35) group by n_nationkey, category, year"
    ),
    "ent_effective": "with {e} select user_id, dashboard_id, sees_all from rule",
    "ent_visible": (
        "with {e} select d.dashboard_id, d.name from dashboards d where exists "
        "(select 1 from eff where eff.user_id = 35 and eff.dashboard_id = d.dashboard_id)"
    ),
    "ent_fetch": (
        "with {e} select d.dashboard_id, d.name from dashboards d where d.dashboard_id = 5 and exists "
        "(select 1 from eff where eff.user_id = 35 and eff.dashboard_id = d.dashboard_id)"
    ),
    "ent_check": (
        "with {e}, req as (select distinct o_custkey as user_id, o_orderkey % 30 as dashboard_id from orders) "
        "select r.user_id, r.dashboard_id, (e.user_id is not null or coalesce(u.role, '') = 'admin') as allowed "
        "from req r left join users u on r.user_id = u.user_id left join eff e on r.user_id = e.user_id "
        "and r.dashboard_id = e.dashboard_id"
    ),
    "ent_denied": (
        "with {e}, req as (select distinct o_custkey as user_id, o_orderkey % 30 as dashboard_id from orders) "
        "select r.user_id, r.dashboard_id from req r left join users u on r.user_id = u.user_id "
        "where coalesce(u.role, '') <> 'admin' and not exists (select 1 from eff e where r.user_id = e.user_id "
        "and r.dashboard_id = e.dashboard_id)"
    ),
    "ent_rows": (
        "with {f}, {e}, agg as (select region, cast(sum(sales) as double) as total_sales from f group by region) "
        "select d.name as region, agg.total_sales from dashboards d join agg on agg.region = d.name "
        "where exists (select 1 from eff e where e.user_id = 35 and e.dashboard_id = d.dashboard_id)"
    ),
    "ent_role": (
        "with {e} select r.user_id, r.dashboard_id, r.sees_all, u.role in ('admin','editor') as can_upload "
        "from rule r join users u on r.user_id = u.user_id"
    ),
    "ent_action": (
        "with {e}, req as (select distinct o_custkey as user_id, o_orderkey % 30 as dashboard_id, "
        "case when o_orderkey % 2 = 0 then 'upload' else 'view' end as action from orders) "
        "select r.user_id, r.dashboard_id, r.action, (e.user_id is not null or coalesce(u.role, '') = 'admin') and "
        "(r.action = 'view' or coalesce(u.role, '') in ('admin','editor')) as allowed "
        "from req r left join users u on r.user_id = u.user_id left join eff e on r.user_id = e.user_id "
        "and r.dashboard_id = e.dashboard_id"
    ),
    "cht_bar": "with {f} select year as x, 'n' as series, count(*) as value from f group by year",
    "cht_line": "with {f} select year as x, 'n' as series, count(*) as value from f group by year",
    "cht_pie": (
        "with {f}, a as (select category as x, sum(sales) as v from f group by category) select x, "
        "cast(v as double) as value, cast(v as double) / cast((select sum(v) from a) as double) * 100 as share from a"
    ),
    "cht_table": (
        "with {f} select category, cast(sum(sales) as double) as total_sales, count(*) as n from f group by category"
    ),
    "cht_dot": "with {f} select brand as x, count(*) as y, max(quantity) as size, min(category) as color from f group by brand",
    "cht_multi": (
        "with {f}, a as (select year, min(quantity) as lo, max(quantity) as hi from f group by year) "
        "select year, 'lo' as series, lo as value from a union all select year, 'hi', hi from a"
    ),
    "cht_combined": (
        "with {f}, g as (select * from f where year = 1998) select 0 as chart_id, category as x, count(*) as value "
        "from g group by category union all select 1, brand, count(*) from g group by brand"
    ),
}


def oracle_sql() -> dict[str, str]:
    """Query name -> DuckDB SQL with the shared CTEs substituted."""
    return {k: v.replace("{f}", F_CTE).replace("{e}", E_CTE) for k, v in _SQL.items()}


def _normalise(v, rounded: bool):
    import math

    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}") if rounded else v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if hasattr(v, "as_tuple"):  # Decimal
        return float(v) if rounded else str(v.normalize())
    return v


def result_digest(columns: list[str], rows: list[tuple], rounded: bool = False) -> str:
    """Order-insensitive hash of a result, columns taken in name order."""
    import hashlib

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted(repr(tuple(_normalise(r[i], rounded) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]
