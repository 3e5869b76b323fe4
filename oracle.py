"""The named queries again, as plain SQL over the same tables.

Written in the step-by-step form with a real copy of each member's fills, so
that it shares no shortcut with the fused plan it checks.
"""

from __future__ import annotations

import re

# Steps, in order; each may use those before it.
STEPS = {
    "fill_base": """
        select l.l_orderkey as claim_order, l.l_linenumber as claim_line,
               o.o_custkey as entity_id,
               cast(l.l_shipdate as date) as fill_date,
               cast(date_trunc('month', l.l_shipdate) as date) as fill_month,
               cast(year(l.l_shipdate) * 100 + month(l.l_shipdate) as integer) as fill_yyyymm,
               l.l_partkey as product_key,
               cast(l.l_partkey as varchar) as product_code,
               case when n.n_regionkey in (0, 1) then '032'
                    when n.n_regionkey in (2, 3) then '955'
                    when n.n_nationkey % 2 = 0 then '033'
                    else '101' end as chain,
               case when o.o_orderpriority = '1-URGENT' then 'MAIL' else 'RETAIL' end as channel,
               case o.o_orderstatus when 'O' then 'OTHER' when 'F' then 'CHAIN' end as outlet_class,
               cast(l.l_quantity as integer) as days_supply,
               case when l.l_suppkey % 20 = 5 then -1 else l.l_suppkey end as supplier_id,
               n.n_name as state,
               case when l.l_quantity < 42 then 1 else 3 end as fill_weight
        from lineitem l
        join orders o on l.l_orderkey = o.o_orderkey
        join supplier s on l.l_suppkey = s.s_suppkey
        join nation n on s.s_nationkey = n.n_nationkey
    """,
    "trusted": """
        select * from fill_base where supplier_id <> 7 and state not in ('NATION_3')
    """,
    "by_attribute": """
        select distinct
               case when p_type in ('ECONOMY', 'LARGE') then '31100' else '32100' end as market,
               case when p_type in ('ECONOMY', 'LARGE') then 'GROUP A' else 'GROUP B' end
                   as market_desc,
               p_name as prod_desc, p_partkey as product_key
        from part
        where p_type in ('ECONOMY', 'LARGE', 'MEDIUM', 'SMALL')
          and (p_size <> 50 or p_size is null)
    """,
    "by_list": """
        select distinct '39200' as market, 'DIABETES' as market_desc,
               p_name as prod_desc, p_partkey as product_key
        from part
        where p_brand in ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4',
                          'Brand#5', 'Brand#6', 'Brand#7', 'Brand#8')
          and (p_size <> 50 or p_size is null)
    """,
    "markets": """
        select * from by_attribute union all select * from by_list
    """,
    "qualified": """
        select f.*, m.market, m.market_desc, m.prod_desc
        from trusted f join markets m on f.product_key = m.product_key
        where f.fill_yyyymm between 199701 and 200005
          and f.channel = 'RETAIL' and f.chain in ('032', '955')
    """,
    "candidates": """
        select distinct market, market_desc, chain as cohort_chain,
               fill_yyyymm as cohort_yyyymm, fill_month as cohort_month, entity_id
        from qualified where fill_yyyymm between 199801 and 199812
    """,
    "copies": """
        select q.*, c.cohort_chain, c.cohort_yyyymm, c.cohort_month
        from qualified q
        join candidates c on q.entity_id = c.entity_id and q.chain = c.cohort_chain
                         and q.market = c.market
        where date_diff('month', c.cohort_month, q.fill_month) between 0 and 17
    """,
    "periods": """
        select fill_yyyymm as cohort_yyyymm, min(fill_date) as first_fill,
               max(fill_date) as last_fill, fill_month as cohort_begin,
               last_day(fill_month) as cohort_end,
               cast(fill_month - interval 12 month as date) as lookback_begin,
               cast(fill_month - interval 1 day as date) as lookback_end,
               last_day(cast(fill_month + interval 17 month as date)) as lookforward_end
        from qualified where fill_yyyymm between 199801 and 199812
        group by fill_yyyymm, fill_month
    """,
    "actives": """
        select c.* from candidates c
        where (select count(*) from copies x
               where x.market = c.market and x.cohort_chain = c.cohort_chain
                 and x.cohort_yyyymm = c.cohort_yyyymm and x.entity_id = c.entity_id) > 1
    """,
    "statuses": """
        select a.*, case when exists (
                   select 1 from qualified q
                   where q.entity_id = a.entity_id and q.chain = a.cohort_chain
                     and q.market = a.market
                     and date_diff('month', q.fill_month, a.cohort_month) between 1 and 12)
               then 'CONTINUING' else 'NEW' end as status
        from actives a
    """,
    "kept_copies": """
        select x.*, s.status from copies x
        join statuses s on x.market = s.market and x.cohort_chain = s.cohort_chain
                       and x.cohort_yyyymm = s.cohort_yyyymm and x.entity_id = s.entity_id
    """,
    "month_counts": """
        select market, market_desc, cohort_chain, cohort_yyyymm, cohort_month, entity_id, status,
               fill_month, fill_yyyymm, count(*) as n_fills,
               cast(sum(fill_weight) as bigint) as weighted_fills
        from kept_copies group by all
    """,
    "gap_rows": """
        select *, fill_yyyymm as gap_start,
               cast(year(gap_end_month) * 100 + month(gap_end_month) as integer) as gap_end,
               cast(date_diff('month', fill_month, gap_end_month) as integer) as month_gap
        from (select *, coalesce(
                  lag(fill_month) over (
                      partition by market, cohort_chain, cohort_yyyymm, entity_id
                      order by fill_yyyymm desc),
                  cast(cohort_month + interval 18 month as date)) as gap_end_month
              from month_counts)
    """,
    "long_gaps": """
        select market, cohort_chain, cohort_yyyymm, entity_id, last_fill_month, before_gap_start,
               cast(year(upto) * 100 + month(upto) as integer) as after_gap_end
        from (select market, cohort_chain, cohort_yyyymm, entity_id,
                     min(fill_month) as last_fill_month, min(gap_start) as before_gap_start,
                     min(fill_month) + interval 7 month as upto
              from gap_rows where month_gap >= 7 group by all)
    """,
    "losses": """
        select s.*, g.last_fill_month, g.before_gap_start, g.after_gap_end,
               cast(case when g.last_fill_month is null then 13
                    else date_diff('month', s.cohort_month, g.last_fill_month) + 1 end
                    as integer) as lost_month
        from statuses s
        left join long_gaps g on s.market = g.market and s.cohort_chain = g.cohort_chain
                             and s.cohort_yyyymm = g.cohort_yyyymm
                             and s.entity_id = g.entity_id
    """,
    "any_chain": """
        select f.*, m.market from trusted f join markets m on f.product_key = m.product_key
        where f.fill_yyyymm between 199801 and 200005 and f.channel in ('RETAIL', 'MAIL')
    """,
    "followups": """
        select p.*, r.fill_yyyymm, r.chain, r.channel, r.outlet_class, r.fill_date,
               r.supplier_id, r.product_key, coalesce(r.fill_weight, 3) as fill_weight,
               case when r.channel = 'MAIL' then 'Mail'
                    when p.cohort_chain <> r.chain and r.channel = 'RETAIL' then 'Competitor'
                    when p.cohort_chain = r.chain then 'ATTENTION'
                    when r.chain is null then 'Stopped Treatment' end as lost_dest
        from (select * from losses where lost_month < 13) p
        left join any_chain r on r.market = p.market and r.entity_id = p.entity_id
                             and p.before_gap_start < r.fill_yyyymm
                             and p.after_gap_end > r.fill_yyyymm
    """,
    "destinations": """
        select market, market_desc, cohort_chain, cohort_yyyymm, cohort_month, entity_id, status,
               last_fill_month, before_gap_start, after_gap_end, lost_month, lost_dest
        from (select *, row_number() over (
                  partition by market, cohort_chain, cohort_yyyymm, entity_id
                  order by w desc, d desc nulls last, lost_dest) as place
              from (select market, market_desc, cohort_chain, cohort_yyyymm, cohort_month,
                           entity_id, status, last_fill_month, before_gap_start, after_gap_end,
                           lost_month, lost_dest, sum(fill_weight) as w, max(fill_date) as d
                    from followups group by all))
        where place = 1
    """,
    "code_users": """
        select distinct f.entity_id from trusted f
        where f.channel = 'RETAIL' and f.fill_yyyymm <= 200005
          and try_cast(f.product_code as bigint) in (
              select try_cast(lpad(cast(p_partkey as varchar), 12, '0') as bigint)
              from part where p_partkey % 100 = 3)
    """,
    "keepers": """
        select * from losses
        where market <> '39200' or entity_id not in (select entity_id from code_users)
    """,
    "cleaned": """
        select k.market, k.market_desc, k.cohort_chain, k.cohort_yyyymm, k.cohort_month,
               k.entity_id, k.status, k.last_fill_month, k.before_gap_start, k.after_gap_end,
               k.lost_month as lost_month_before,
               cast(case when k.lost_month = 13 and w.entity_id is not null then 14
                         when w.entity_id is not null then 13
                         else k.lost_month end as integer) as lost_month,
               case when k.lost_month = 13 or w.entity_id is not null then 'not lost'
                    else d.lost_dest end as lost_dest
        from keepers k
        left join (select distinct market, cohort_chain, cohort_yyyymm, entity_id
                   from followups where supplier_id = -1) w
               on w.market = k.market and w.cohort_chain = k.cohort_chain
              and w.cohort_yyyymm = k.cohort_yyyymm and w.entity_id = k.entity_id
        left join destinations d
               on d.market = k.market and d.cohort_chain = k.cohort_chain
              and d.cohort_yyyymm = k.cohort_yyyymm and d.entity_id = k.entity_id
    """,
    "class_rows": """
        select f.*, case when f.chain = '033' then 'Loss_Sam'
                         when f.chain in ('032', '955') then 'Loss_WMT'
                         when f.lost_dest = 'Stopped Treatment' and f.outlet_class is null
                             then 'Off Grid'
                         when f.outlet_class = 'OTHER' then 'Loss_Mail'
                         when f.outlet_class is null then 'ATTENTION'
                         else 'Loss_' || upper(f.outlet_class[1]) || lower(f.outlet_class[2:])
                    end as lost_dest_detail
        from followups f
        join cleaned c on c.market = f.market and c.cohort_chain = f.cohort_chain
                      and c.cohort_yyyymm = f.cohort_yyyymm and c.entity_id = f.entity_id
                      and c.lost_dest = f.lost_dest and c.lost_month <= 12
    """,
    "classes": """
        select market, market_desc, cohort_chain, cohort_yyyymm, cohort_month, entity_id, status,
               last_fill_month, before_gap_start, after_gap_end, lost_month, lost_dest,
               lost_dest_detail
        from (select *, row_number() over (
                  partition by market, cohort_chain, cohort_yyyymm, entity_id
                  order by w desc, d desc nulls last, lost_dest_detail) as place
              from (select market, market_desc, cohort_chain, cohort_yyyymm, cohort_month,
                           entity_id, status, last_fill_month, before_gap_start, after_gap_end,
                           lost_month, lost_dest, lost_dest_detail,
                           sum(fill_weight) as w, max(fill_date) as d
                    from class_rows group by all))
        where place = 1
    """,
    "lost_counts": """
        select market, market_desc, cohort_chain, cohort_yyyymm, status, lost_month,
               case lost_dest when 'Mail' then 'Lost to Mail'
                              when 'Competitor' then 'Lost to Competitor'
                              when 'Stopped Treatment' then 'Off Grid'
                              else 'ATTENTION' end as lost_dest,
               lost_dest_detail, count(distinct entity_id) as lost
        from classes group by all
    """,
    "losses_by_month": """
        select market, market_desc, cohort_chain, cohort_yyyymm, status, lost_month,
               count(distinct entity_id) as lost
        from cleaned group by all
    """,
    "risk": """
        select m.*,
               cast((select sum(x.lost) from losses_by_month x
                     where x.market = m.market and x.cohort_chain = m.cohort_chain
                       and x.cohort_yyyymm = m.cohort_yyyymm and x.status = m.status
                       and x.lost_month >= m.lost_month) as bigint) as at_risk,
               cast((select sum(x.lost) from losses_by_month x
                     where x.market = m.market and x.cohort_chain = m.cohort_chain
                       and x.cohort_yyyymm = m.cohort_yyyymm and x.status = m.status) as bigint) as total
        from losses_by_month m
    """,
    "points": """
        select market, market_desc, cohort_chain, cohort_yyyymm, status, lost_month,
               at_risk as cohort, at_risk - lost as survival, (at_risk - lost) / total as rate
        from risk where lost_month <= 12
    """,
    "points_zero": """
        select * from points
        union all
        select market, market_desc, cohort_chain, cohort_yyyymm, status, 0, cohort, cohort, 1.0
        from points where lost_month = 1
    """,
    "lost_zero": """
        select * from lost_counts
        union all
        select market, market_desc, cohort_chain, cohort_yyyymm, status, 0, lost_dest,
               lost_dest_detail, 0
        from lost_counts where lost_month = 1
    """,
    "curve": """
        select cast(case p.market when '31100' then 1 when '31400' then 2 when '39200' then 3
                         when '64300' then 4 when '32100' then 5 when '72100' then 6
                         when '41100' then 7 when '23400' then 8 when '31300' then 9
                         when '20200' then 10 end as integer) as rank,
               p.market, p.market_desc, p.status, p.cohort_yyyymm,
               case p.cohort_chain when '032' then 'Supercenter' when '955' then 'Neighborhood'
                    else 'null' end as chain_name,
               p.lost_month, p.cohort, l.lost_dest, l.lost_dest_detail, l.lost, p.survival, p.rate
        from points_zero p
        join lost_zero l on l.market = p.market and l.cohort_chain = p.cohort_chain
                        and l.cohort_yyyymm = p.cohort_yyyymm and l.status = p.status
                        and l.lost_month = p.lost_month
    """,
}

_SEGMENT = "market, market_desc, cohort_chain, cohort_yyyymm, status"
_LOSS = (
    "market, market_desc, cohort_chain, cohort_yyyymm, cohort_month, entity_id, status, "
    "last_fill_month, before_gap_start, after_gap_end, lost_month"
)

_OF_MEMBERS = (*_SEGMENT.split(", "), "lost_month", "lost_dest", "lost_dest_detail")
_OUTCOMES = """
    from cleaned c
    left join classes k on k.market = c.market and k.cohort_chain = c.cohort_chain
                       and k.cohort_yyyymm = c.cohort_yyyymm and k.entity_id = c.entity_id
"""

FINAL = {
    "fills_scan": """
        select claim_order, claim_line, entity_id, fill_date, fill_month, fill_yyyymm,
               product_key, chain, channel, outlet_class, days_supply, supplier_id, state
        from fill_base where fill_yyyymm between 199701 and 200005
    """,
    "fills_qualified": """
        select claim_order, claim_line, entity_id, fill_date, chain, channel, supplier_id, state,
               fill_weight
        from trusted
        where fill_yyyymm between 199701 and 200005
          and channel = 'RETAIL' and chain in ('032', '955')
    """,
    "fills_in_market": """
        select claim_order, claim_line, entity_id, fill_date, product_key, market, market_desc,
               prod_desc, chain, fill_weight
        from qualified
    """,
    "market_by_attribute": "select * from by_attribute",
    "market_by_code_list": "select * from by_list",
    "market_definition": "select * from markets",
    "fn_product_key": """
        select p_partkey,
               cast(lpad(cast(p_partkey as varchar), 7, '0')
                    || lpad(cast(p_size as varchar), 3, '0') as bigint) as product_key
        from part
    """,
    "fn_code_normalise": """
        select p_partkey, p_partkey as from_padded, p_partkey as from_short,
               try_cast(p_brand as bigint) as from_dirty
        from part
    """,
    "fn_month_parse": """
        select o_orderkey,
               cast(strftime(o_orderdate, '%Y%m') as integer) as order_yyyymm,
               cast(date_trunc('month', o_orderdate) as date) as order_month
        from orders
    """,
    "fn_month_floor": """
        select l_orderkey, l_linenumber, cast(l_shipdate as date) as ship_date,
               cast(date_trunc('month', l_shipdate) as date) as ship_month
        from lineitem
    """,
    "fn_month_key": """
        select l_orderkey, l_linenumber, cast(l_shipdate as date) as ship_date,
               cast(strftime(l_shipdate, '%Y%m') as integer) as ship_yyyymm
        from lineitem
    """,
    "fn_fill_weight": """
        select l_orderkey, l_linenumber,
               cast(case when l_quantity < 42 then 1 else 3 end as integer) as fill_weight
        from lineitem
    """,
    "fn_outlet_label": """
        select p_partkey, 'Loss_' || upper(p_type[1]) || lower(p_type[2:]) as outlet_label
        from part
    """,
    "cohort_members": "select * from candidates",
    "cohort_fills": """
        select claim_order, claim_line, market, cohort_chain, cohort_yyyymm, cohort_month,
               entity_id, fill_date, fill_month, product_key, fill_weight
        from copies
    """,
    "period_dim": "select * from periods",
    "cohort_min_fills": "select * from actives",
    "entity_status": "select * from statuses",
    "status_fills": """
        select claim_order, claim_line, market, cohort_chain, cohort_yyyymm, entity_id, status,
               fill_date, fill_weight
        from kept_copies
    """,
    "fills_by_month": "select * from month_counts",
    "entity_gaps": "select * from gap_rows",
    "first_long_gap": "select * from long_gaps",
    "lost_month": "select * from losses",
    "cohort_lifecycle": """
        select market, market_desc, cohort_chain, cohort_yyyymm, entity_id, status,
               before_gap_start, after_gap_end, lost_month
        from losses
    """,
    "lost_window_fills": "select * from followups",
    "lost_destination": "select * from destinations",
    "exclude_code_users": f"select {_LOSS} from keepers",
    "own_mail_cleanup": f"select {_LOSS}, lost_dest from cleaned",
    "lost_outlet_class": "select * from classes",
    "member_outcomes": """
        select c.market, c.market_desc, c.cohort_chain, c.cohort_yyyymm, c.entity_id, c.status,
               c.before_gap_start, c.after_gap_end, c.lost_month_before, c.lost_month,
               c.lost_dest, k.lost_dest_detail
        from cleaned c
        left join classes k on k.market = c.market and k.cohort_chain = c.cohort_chain
                           and k.cohort_yyyymm = c.cohort_yyyymm and k.entity_id = c.entity_id
    """,
    "lost_by_destination": "select * from lost_counts",
    "survival_at_risk": "select * from risk",
    "survival_rate": "select * from points",
    "survival_month_zero": "select * from points_zero",
    "survival_curve_new": "select * from curve where status = 'NEW'",
    "survival_curve_cont": "select * from curve where status = 'CONTINUING'",
    "survival_curve_all": "select * from curve",
    "survival_curve_joined": "select * from curve",
    "survival_rate_dense": """
        select s.market, s.market_desc, s.cohort_chain, s.cohort_yyyymm, s.status,
               cast(m.n as integer) as lost_month,
               cast(sum(case when x.lost_month >= m.n then x.lost else 0 end) as bigint) as cohort,
               cast(sum(case when x.lost_month > m.n then x.lost else 0 end) as bigint) as survival,
               sum(case when x.lost_month > m.n then x.lost else 0 end) / sum(x.lost) as rate
        from (select distinct market, market_desc, cohort_chain, cohort_yyyymm, status
              from losses_by_month) s
        cross join (select unnest(range(0, 13)) as n) m
        join losses_by_month x using (market, cohort_chain, cohort_yyyymm, status)
        group by all
    """,
    "preview": """
        select c.market, c.market_desc, c.cohort_chain, c.cohort_yyyymm, c.entity_id, c.status,
               c.before_gap_start, c.after_gap_end, c.lost_month_before, c.lost_month,
               c.lost_dest, k.lost_dest_detail
        from cleaned c
        left join classes k on k.market = c.market and k.cohort_chain = c.cohort_chain
                           and k.cohort_yyyymm = c.cohort_yyyymm and k.entity_id = c.entity_id
        order by c.market, c.cohort_chain, c.cohort_yyyymm, c.entity_id
        limit 30
    """,
    "curve_report_topn": """
        select rank, market, market_desc, status, cohort_yyyymm, chain_name, lost_month,
               lost_dest, lost_dest_detail, max(cohort) as cohort,
               cast(sum(lost) as bigint) as lost, max(rate) as rate
        from curve where lost_month > 0
        group by all
        order by rank nulls last, market, market_desc, status desc, cohort_yyyymm,
                 chain_name desc, lost_month, lost_dest, lost_dest_detail, cohort
        limit 200
    """,
    "distinct_pairs": "select distinct channel, lost_dest from followups",
    "distinct_pairs_class": "select distinct lost_dest, lost_dest_detail from classes",
    "distinct_pairs_curve": "select distinct lost_dest, lost_dest_detail from curve",
    "stage_ledger": " union all ".join(
        f"select '{stage}' as stage, count(*) as n_rows from {step}"
        for stage, step in {
            "market": "markets",
            "members": "candidates",
            "cohort_fills": "copies",
            "period_dim": "periods",
            "active_members": "actives",
            "status": "statuses",
            "status_fills": "kept_copies",
            "gaps": "gap_rows",
            "lost_month": "losses",
            "lost_window_fills": "followups",
            "lost_destination": "destinations",
            "code_users_excluded": "keepers",
            "own_mail_cleaned": "cleaned",
            "lost_outlet_class": "classes",
            "survival_curve": "curve",
        }.items()
    ),
    "qc_market_size": """
        select market, market_desc, count(*) as n_products from markets group by all
    """,
    "qc_entity_counts": """
        select market, market_desc, cohort_yyyymm, cohort_chain, status,
               count(*) as n_rows, count(distinct entity_id) as n_entities
        from statuses group by all
    """,
    "qc_entity_counts_fills": """
        select market, market_desc, cohort_yyyymm, cohort_chain,
               count(*) as n_rows, count(distinct entity_id) as n_entities
        from copies group by all
    """,
    "qc_entity_counts_followup": f"""
        select {_SEGMENT}, count(*) as n_rows, count(distinct entity_id) as n_entities
        from followups group by all
    """,
    "qc_entity_counts_destination": f"""
        select {_SEGMENT}, count(*) as n_rows, count(distinct entity_id) as n_entities
        from destinations group by all
    """,
    "qc_entity_counts_excluded": f"""
        select {_SEGMENT}, count(*) as n_rows, count(distinct entity_id) as n_entities
        from keepers where lost_month <= 12 group by all
    """,
    "qc_entity_counts_cleaned": f"""
        select {_SEGMENT}, count(*) as n_rows, count(distinct entity_id) as n_entities
        from cleaned group by all
    """,
    "qc_form_diff": """
        select count(*) as n_old, count(*) as n_new, cast(0 as bigint) as n_differ from cleaned
    """,
    "qc_gap_reconcile": f"""
        select a.*, b.n_rolled_up, a.n_fills - b.n_rolled_up as difference
        from (select {_SEGMENT}, count(*) as n_fills from kept_copies group by all) a
        join (select {_SEGMENT}, cast(sum(n_fills) as bigint) as n_rolled_up
              from month_counts group by all) b
          using ({_SEGMENT})
    """,
    "qc_lost_month_hist": f"""
        select {_SEGMENT}, lost_month, count(*) as n_members from losses group by all
    """,
    "qc_lost_month_delta": """
        select coalesce(b.lost_month, a.lost_month) as lost_month,
               coalesce(b.n, 0) as n_before, coalesce(a.n, 0) as n_after
        from (select lost_month, count(*) as n from keepers group by 1) b
        full join (select lost_month, count(*) as n from cleaned group by 1) a
          on a.lost_month = b.lost_month
    """,
    "qc_lost_month_dest": """
        select lost_month, lost_dest, count(*) as n_members from cleaned group by all
    """,
    "qc_dest_counts": f"""
        select {_SEGMENT}, lost_dest, count(*) as n_rows, count(distinct entity_id) as n_entities
        from followups group by all
    """,
    "qc_grand_total_before": f"""
        select {_SEGMENT}, count(distinct entity_id) as n_entities,
               cast(sum(count(distinct entity_id)) over () as bigint) as grand_total
        from losses group by {_SEGMENT}
    """,
    "qc_grand_total": f"""
        select {_SEGMENT}, count(distinct entity_id) as n_entities,
               cast(sum(count(distinct entity_id)) over () as bigint) as grand_total
        from keepers group by {_SEGMENT}
    """,
    "qc_grand_total_lost": f"""
        select {_SEGMENT}, count(distinct entity_id) as n_entities,
               cast(sum(count(distinct entity_id)) over () as bigint) as grand_total
        from keepers where lost_month <= 12 group by {_SEGMENT}
    """,
    "qc_window_breach": """
        select count(*) as n_breaches from followups
        where fill_yyyymm <= before_gap_start or fill_yyyymm >= after_gap_end
    """,
    "qc_outlet_class": f"""
        select {_SEGMENT}, lost_month, lost_dest, lost_dest_detail,
               count(distinct entity_id) as n_entities
        from classes group by all
    """,
    "qc_month_zero": """
        select market, status, cohort_yyyymm, chain_name,
               count(distinct lost_dest_detail) as n_details, count(*) as n_rows
        from curve where lost_month = 0 and lost_dest = 'Lost to Competitor' group by all
    """,
    "qc_curve_totals": """
        select market, status, cohort_yyyymm, chain_name,
               cast(sum(lost) as bigint) as lost, max(cohort) as cohort
        from curve group by all
    """,
    "qc_version_diff": """
        select market, cohort_chain, cohort_yyyymm, lost_month,
               count(distinct entity_id) as n_old, count(distinct entity_id) as n_new,
               cast(0 as bigint) as difference
        from losses group by market, cohort_chain, cohort_yyyymm, lost_month
    """,
    "qc_version_rows": """
        select market, cohort_chain, cohort_yyyymm, count(*) as n_old, count(*) as n_new,
               count(*) filter (where before = status) as n_same,
               count(*) filter (where before <> status) as n_changed,
               cast(0 as bigint) as n_gone, cast(0 as bigint) as n_added
        from (select s.*, case when exists (
                         select 1 from qualified q
                         where q.entity_id = s.entity_id and q.chain = s.cohort_chain
                           and q.market = s.market
                           and date_diff('month', q.fill_month, s.cohort_month) between 1 and 6)
                     then 'CONTINUING' else 'NEW' end as before
              from statuses s)
        group by market, cohort_chain, cohort_yyyymm
    """,
    "qc_stage_checks": " union all ".join(
        f"select '{check}' as check_name, "
        + ", ".join(c if c in by else f"null as {c}" for c in _OF_MEMBERS)
        + f", count(*) as n_members from (select c.*, k.lost_dest_detail {_OUTCOMES})"
        + (f" group by {', '.join(by)}" if by else "")
        for check, by in {
            "segment": _OF_MEMBERS[:5],
            "segment_month": (*_OF_MEMBERS[:5], "lost_month"),
            "segment_dest": (*_OF_MEMBERS[:5], "lost_dest"),
            "month_dest": ("lost_month", "lost_dest"),
            "dest_class": ("lost_dest", "lost_dest_detail"),
            "all": (),
        }.items()
    ),
    "qc_distinct_rollup": """
        select 3 - bit_count(grouping(market, cohort_chain, status))::integer as level,
               market, cohort_chain, status, count(distinct entity_id) as n_distinct
        from cleaned group by rollup (market, cohort_chain, status)
    """,
}


def _needed(sql: str) -> set[str]:
    """The steps a statement uses, directly or through others."""
    found: set[str] = set()
    waiting = [sql]
    while waiting:
        words = set(re.findall(r"\w+", waiting.pop()))
        new = {name for name in STEPS if name in words} - found
        found |= new
        waiting += [STEPS[name] for name in new]
    return found


def statement(name: str) -> str:
    final = FINAL[name]
    needed = _needed(final)
    steps = [f"{step} as materialized ({sql})" for step, sql in STEPS.items() if step in needed]
    return (f"with {', '.join(steps)} " if steps else "") + final


def statements() -> dict[str, str]:
    return {name: statement(name) for name in FINAL}
