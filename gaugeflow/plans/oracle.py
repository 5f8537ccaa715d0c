"""DuckDB twins of the views and intermediate results, as named common table expressions."""

from __future__ import annotations

import re

NUM = r"cast(regexp_extract(site_no, '(\d+)', 1) as integer)"


def wy(d: str) -> str:
    return f"(year({d}) + case when month({d}) >= 10 then 1 else 0 end)"


def wy_day(d: str) -> str:
    return f"(({d}) - make_date(cast({wy(d)} - 1 as integer), 10, 1) + 1)"


def filled(column: str) -> str:
    """A daily column on the whole calendar of a site, interpolated linearly."""
    return f"""select site_no, date, q, case when q is not null then q else q0 + (q1 - q0) * (date - d0) / (d1 - d0) end as filled_q,
    case when q is null then 'yes' else 'no' end as interp_flag from (
    select c.site_no, c.date, d.{column} as q, last_value(d.{column} ignore nulls) over b as q0, first_value(d.{column} ignore nulls) over f as q1,
        last_value(d.date ignore nulls) over b as d0, first_value(d.date ignore nulls) over f as d1
    from calendar c left join days d on c.site_no = d.site_no and c.date = d.date
    window b as (partition by c.site_no order by c.date rows between unbounded preceding and current row),
           f as (partition by c.site_no order by c.date rows between current row and unbounded following))"""


CTES: dict[str, str] = {
    "shipments": "select p_brand as site_no, cast(l_shipdate as date) as date, p_type, l_quantity, l_extendedprice, l_tax, l_discount, l_returnflag from lineitem join part on l_partkey = p_partkey",
    "days": """select site_no, date, sum(l_quantity) as q, avg(floor(l_extendedprice / l_quantity * 1024) / 1024) as ratio,
        avg(floor(l_extendedprice / l_quantity * 1024) / 1024) filter (where l_returnflag = 'A') as a_ratio, sum(floor(l_tax * 100 + 0.5)) as tax,
        sum(floor(l_discount * 100 + 0.5)) as discount, avg(l_quantity) as mean_q, sum(l_quantity) filter (where l_returnflag = 'R') as r_q
        from shipments group by 1, 2""",
    "daily_q": "select site_no, date, q from days",
    "samples": "select site_no, date as sample_dt, a_ratio as result_va from days where a_ratio is not null",
    "daily_est": "select site_no, date, q, ratio as gen_conc from days",
    "et": "select site_no, date as dates, -tax / 131072 as value from days",
    "precip": "select site_no, date as dates, discount / 131072 as value from days",
    "temp": "select site_no, date as dates, floor(mean_q * 1024) / 1024 + 253.125 as value from days",
    "calendar": """select site_no, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as date
        from (select site_no, min(date) as lo, max(date) as hi from days group by 1)""",
    "swe": """select c.site_no, c.date as dates, coalesce(case when month(c.date) in (11, 12, 1, 2, 3, 4) then d.r_q end / 1000, 0.0) as value
        from calendar c left join days d on c.site_no = d.site_no and c.date = d.date""",
    "site_info": f"""select *, 30.0 + {NUM} % 20 as lat, -120.0 + {NUM} % 15 as lon from (select p_brand as site_no,
        cast(sum(p_size) as double) as drain_area_va, avg(floor(p_retailprice)) as mean_elevation, avg(p_size) as mean_slope from part group by 1)""",
    "zones": f"select site_no, r_name as zone from site_info join region on r_regionkey = {NUM} % 5",
    "land_cover": "select site_no, year(date) as year, p_type as class, sum(l_extendedprice) as area from shipments group by 1, 2, 3",
    "geology": """select k.site_no, lith, size / total as proportion from
        (select p_brand as site_no, p_type as lith, sum(p_size) as size from part group by 1, 2) k
        join (select p_brand as site_no, sum(p_size) as total from part group by 1) t on k.site_no = t.site_no""",
    "attributes": """select site_no, cast(case when s % 7 = 0 then -999 else s end as double) as a1,
        cast(case when n % 3 = 0 then -999 else n end as double) as a2
        from (select p_brand as site_no, sum(p_size) as s, count(*) as n from part group by 1)""",
    "site_catalog": """select distinct cast(c_custkey as varchar) as site_no, case when c_mktsegment = 'MACHINERY' then 'LK' else 'ST' end as site_tp_cd, parameter_cd
        from (select o_custkey, '00060' as parameter_cd from orders where o_orderpriority = '1-URGENT'
              union all select o_custkey, '00095' from orders where o_orderstatus = 'P') join customer on o_custkey = c_custkey""",
    "filled": filled("q"),
    "filled_ratio": filled("ratio"),
    "est_full": "select f.site_no, f.date, f.filled_q as q, r.filled_q as gen_conc from filled f join filled_ratio r on f.site_no = r.site_no and f.date = r.date",
    "runs": """select site_no, coalesce(max(n), 0) as max_run from (
        select site_no, interp_flag, count(*) as n from (select site_no, date, interp_flag,
            row_number() over (partition by site_no order by date) - row_number() over (partition by site_no, interp_flag order by date) as grp from filled)
        group by site_no, interp_flag, grp) where interp_flag = 'yes' group by 1""",
    "all_runs": "select s.site_no, coalesce(max_run, 0) as max_run from (select distinct site_no from filled) s left join runs r on s.site_no = r.site_no",
    "complete": f"""select f.site_no, f.date, f.filled_q as q, {wy('f.date')} as water_year from filled f join
        (select site_no, {wy('date')} as w from filled group by 1, 2 having count(distinct date) >= 365) k
        on f.site_no = k.site_no and {wy('f.date')} = k.w""",
    "q5_plain": "select site_no, year(date) as year, quantile_cont(q, 0.05) as q5 from complete where month(date) between 8 and 10 group by 1, 2",
    "q5_long": "select site_no, year(date) as year, quantile_cont(q, 0.05) as q5 from complete where month(date) between 5 and 11 group by 1, 2",
    "q5": """select *, (q5 - min(q5) over (partition by site_no)) / nullif(max(q5) over (partition by site_no) - min(q5) over (partition by site_no), 0) as norm_q5 from q5_plain""",
    "members": "select site_no, quantile_cont(result_va, 0.01) as runoff, quantile_cont(result_va, 0.99) as gw from samples group by 1",
    "members_mid": "select site_no, quantile_cont(result_va, 0.4) as runoff, quantile_cont(result_va, 0.6) as gw from samples group by 1",
    "separated": """select e.site_no, date, q, gen_conc, q * ((gen_conc - runoff) / (gw - runoff)) as bf,
        q * ((gen_conc - runoff) / (gw - runoff)) / nullif(q, 0) as bf_percent from daily_est e join members m on e.site_no = m.site_no""",
    "est_complete": f"""select e.*, {wy('e.date')} as water_year from est_full e join complete c on e.site_no = c.site_no and e.date = c.date""",
    "annual_all": """select e.site_no, water_year, median(q * ((gen_conc - runoff) / (gw - runoff)) / nullif(q, 0)) as median_bf
        from est_complete e join members m on e.site_no = m.site_no group by 1, 2""",
    "annual_bf": "select * from annual_all where site_no in (select site_no from annual_all group by 1 having count(*) >= 5)",
    "annual_mid": """select e.site_no, water_year, median(q * ((gen_conc - runoff) / (gw - runoff)) / nullif(q, 0)) as median_bf
        from est_complete e join members_mid m on e.site_no = m.site_no group by 1, 2""",
    "mid_flags": "select site_no, count(*) filter (where median_bf < 0 or median_bf > 1) as n_outside, case when bool_or(median_bf < 0 or median_bf > 1) then 'flag' else 'fine' end as flag from annual_mid group by 1",
    "site_years": """select a.site_no, a.water_year, median_bf as bf_prop, q5, norm_q5 from annual_bf a
        left join q5 on a.site_no = q5.site_no and a.water_year = q5.year""",
    "normalised": """select site_no, water_year, median_bf, lowflow, avg(lowflow) over s as mean_lowflow,
        (lowflow - avg(lowflow) over s) / nullif(avg(lowflow) over s, 0) as diff_mean_lowflow,
        (lowflow - min(lowflow) over s) / nullif(max(lowflow) over s - min(lowflow) over s, 0) as norm_minmax,
        (lowflow - avg(lowflow) over s) / nullif(stddev_samp(lowflow) over s, 0) as norm_zscore, min(water_year) over s as min_year
        from (select a.site_no, water_year, median_bf, q5 as lowflow from annual_bf a join q5_long on a.site_no = q5_long.site_no and a.water_year = q5_long.year
              where median_bf is not null and q5 is not null) window s as (partition by site_no)""",
    "changes": """select * from (select site_no, date, q, prev, q - prev as dq, (q - prev) / (date - day_before) as dq_dt from (
        select site_no, date, q, lag(q) over w as prev, lag(date) over w as day_before from daily_q window w as (partition by site_no order by date)))
        where dq is not null and case when prev = 0 then q > 0 else q / prev >= 0.7 end""",
    "recession": "select site_no, date, q, -dq_dt as recession from changes where dq < 0",
    "slopes": """select site_no, regr_slope(recession, q) as recession_curve_slope, regr_intercept(recession, q) as intercept,
        regr_r2(recession, q) as r2, regr_count(recession, q) as n from recession group by 1""",
    "evap": f"select site_no, {wy('dates')} as water_year, sum(value) * -1000 as annual_evap_mm from et group by 1, 2",
    "prec": f"select site_no, {wy('dates')} as water_year, sum(value) * 1000 as annual_precip_mm from precip group by 1, 2",
    "tair": f"select site_no, {wy('dates')} as water_year, avg(value) - 273.15 as mean_temp_c from temp group by 1, 2",
    "snow_days": f"select site_no, dates, greatest(value, 0) as value, {wy('dates')} as water_year, {wy_day('dates')} as wy_day from swe",
    "peak": """select site_no, water_year, wy_day as peak_swe_day, value * 1000 as peak_swe_mm from (
        select *, row_number() over (partition by site_no, water_year order by value desc, dates) as rn from snow_days) where rn = 1""",
    "snow_blocks": """select *, sum(case when value = 0 and prev <> 0 then 1 else 0 end) over (partition by site_no, water_year order by dates) as block
        from (select *, lag(value, 1, 1) over (partition by site_no, water_year order by dates) as prev from snow_days)""",
    "snow": """select site_no, water_year, peak_swe_day, peak_swe_mm, min(d) as sdd, peak_swe_mm / (min(d) - peak_swe_day) as melt_rate from (
        select b.site_no, b.water_year, peak_swe_day, peak_swe_mm, block, min(wy_day) as d from snow_blocks b
        join peak p on b.site_no = p.site_no and b.water_year = p.water_year where value = 0 and wy_day > peak_swe_day
        group by 1, 2, 3, 4, 5 having count(*) >= 7) group by 1, 2, 3, 4""",
    "panel": """select s.site_no, s.water_year, bf_prop, q5, norm_q5, annual_evap_mm, annual_precip_mm, mean_temp_c, peak_swe_day, peak_swe_mm, sdd, melt_rate,
        b.mean_bf, drain_area_va, mean_elevation, mean_slope, lat, lon, zone, recession_curve_slope
        from site_years s left join evap e on s.site_no = e.site_no and s.water_year = e.water_year
        left join prec p on s.site_no = p.site_no and s.water_year = p.water_year
        left join tair t on s.site_no = t.site_no and s.water_year = t.water_year
        left join snow n on s.site_no = n.site_no and s.water_year = n.water_year
        left join (select site_no, avg(bf_prop) as mean_bf from site_years group by 1) b on s.site_no = b.site_no
        left join site_info i on s.site_no = i.site_no left join zones z on s.site_no = z.site_no left join slopes r on s.site_no = r.site_no""",
    "frame": """select *, q5 / (drain_area_va * 2.58999e6) * 86400000 as q5_norm from panel where q5 is not null and bf_prop is not null
        and recession_curve_slope is not null and annual_evap_mm is not null and annual_precip_mm is not null and mean_temp_c is not null
        and peak_swe_day is not null and sdd is not null and melt_rate is not null and mean_elevation is not null and mean_slope is not null and mean_bf is not null""",
    "res_a": "select site_no, year as water_year, q5 as q5_norm, avg(q5) over (partition by site_no) as pred, q5 - avg(q5) over (partition by site_no) as residual from q5_plain",
    "res_b": "select site_no, year as water_year, q5 as q5_norm, avg(q5) over (partition by year) as pred, q5 - avg(q5) over (partition by year) as residual from q5_plain",
    "classes": """select *, case when abs(residual_a) >= threshold then 'poor prediction' when abs(residual_a) < threshold then 'good prediction' end as class_a,
        case when abs(residual_b) >= threshold then 'poor prediction' when abs(residual_b) < threshold then 'good prediction' end as class_b,
        case when res_diff > 0 then 'positive' when res_diff <= 0 then 'negative' end as pos_neg from (
        select a.site_no, a.water_year, a.q5_norm, a.pred as pred_a, a.residual as residual_a, b.pred as pred_b, b.residual as residual_b,
            a.q5_norm * 0.5 as threshold, abs(a.residual) - abs(b.residual) as res_diff
        from res_a a left join res_b b on a.site_no = b.site_no and a.water_year = b.water_year)""",
    "joined": """select *, case when q5 > 1.25 * median_q5 then 'high' when q5 < 0.75 * median_q5 then 'low' else 'median' end as flow from (
        select c.*, c.q5_norm as q5, zone, annual_evap_mm, annual_precip_mm, peak_swe_mm, median(c.q5_norm) over (partition by c.site_no) as median_q5
        from classes c left join zones z on c.site_no = z.site_no
        left join evap e on c.site_no = e.site_no and c.water_year = e.water_year
        left join prec p on c.site_no = p.site_no and c.water_year = p.water_year
        left join peak k on c.site_no = k.site_no and c.water_year = k.water_year)""",
    "improved": "select * from joined where class_a = 'poor prediction' and pos_neg = 'positive'",
    "metrics": """select e.site_no, e.water_year, annual_evap_mm, annual_precip_mm, mean_temp_c from evap e
        join prec p on e.site_no = p.site_no and e.water_year = p.water_year join tair t on e.site_no = t.site_no and e.water_year = t.water_year""",
    "shap_stub": """select site_no, water_year, 'annual_evap_mm' as feature, annual_evap_mm - avg(annual_evap_mm) over () as phi from metrics
        union all select site_no, water_year, 'annual_precip_mm', annual_precip_mm - avg(annual_precip_mm) over () from metrics
        union all select site_no, water_year, 'mean_temp_c', mean_temp_c - avg(mean_temp_c) over () from metrics""",
    "segmented": f"""select * from (select *, count(*) over (partition by site_no, segment) as segment_obs from (
        select *, sum(case when rn = 1 or gap_days > 18 then 1 else 0 end) over (partition by site_no order by sample_dt) as segment from (
        select *, row_number() over w as rn, lead(sample_dt) over w as nxt from (
        select site_no, sample_dt, result_va, sample_dt - lag(sample_dt) over (partition by site_no order by sample_dt) as gap_days from samples)
        where gap_days is not null window w as (partition by site_no order by sample_dt)) where nxt is not null)) where segment_obs >= 60""",
    "reclassed": """select site_no, sum(n) as n_obs, count(*) filter (where obs >= 60) as n_long_segments from (
        select site_no, segment, count(*) as n, count(*) filter (where nxt is not null) as obs from (
        select site_no, sum(case when prev is null or sample_dt - prev > 18 then 1 else 0 end) over (partition by site_no order by sample_dt) as segment, nxt from (
        select site_no, sample_dt, lag(sample_dt) over w as prev, lead(sample_dt) over w as nxt from segmented window w as (partition by site_no order by sample_dt)))
        group by 1, 2) group by 1""",
    "screen_bounds": "select site_no, min(sample_dt) as lo, max(sample_dt) as hi from samples group by 1",
}


def with_ctes(select: str) -> str:
    """Prefix a select with the expressions it uses, directly or through others, in order."""
    words = re.compile(r"[a-z_0-9]+")
    needed: set[str] = set()
    todo = [select]
    while todo:
        for word in set(words.findall(todo.pop())):
            if word in CTES and word not in needed:
                needed.add(word)
                todo.append(CTES[word])
    chosen = [f"{name} as ({CTES[name]})" for name in CTES if name in needed]
    return f"with {', '.join(chosen)} {select}" if chosen else select
