"""DuckDB SQL for each query: the same rows, worked out independently in plain SQL."""

from __future__ import annotations

_TRADES = """trades as (
  select l_orderkey*10+l_linenumber as trade_id, o_orderpriority as system,
         case when l_returnflag='R' then 'S' else 'L' end as action,
         concat('P', cast(l_partkey as varchar)) as ticker,
         least(cast(o_orderdate as date), cast(l_shipdate as date)) as entry_date,
         l_extendedprice/l_quantity as entry_price,
         cast(l_quantity as bigint) as quantity,
         cast(cast(l_extendedprice as decimal(12,2))*cast(l_tax as decimal(4,2)) as decimal(18,4)) as commission,
         greatest(cast(o_orderdate as date), cast(l_shipdate as date)) as exit_date,
         cast(cast(l_extendedprice as decimal(12,2))
              *(cast(l_discount as decimal(4,2))-cast(l_tax as decimal(4,2))) as decimal(18,4)) as pl
  from lineitem join orders on l_orderkey=o_orderkey where l_linestatus='F')"""

_OPEN = """open_pl as (
  select cast(l_shipdate as date) as date, o_orderpriority as system,
         case when l_returnflag='R' then 'S' else 'L' end as action,
         concat('P', cast(l_partkey as varchar)) as ticker, cast(l_quantity as bigint) as qty,
         cast(cast(l_extendedprice as decimal(12,2))
              *(cast(l_discount as decimal(4,2))-cast(l_tax as decimal(4,2))) as decimal(18,4)) as pl
  from lineitem join orders on l_orderkey=o_orderkey where l_linestatus='O')"""

_BARS = """bars as (
  select cast(o_orderdate as date) as date,
         min_by(cast(o_totalprice as decimal(12,2)), o_orderkey) as open,
         max(cast(o_totalprice as decimal(12,2))) as high,
         min(cast(o_totalprice as decimal(12,2))) as low,
         max_by(cast(o_totalprice as decimal(12,2)), o_orderkey) as close
  from orders group by 1)"""

_CALENDAR = "calendar as (select date from bars where date >= date '1995-01-01')"

_BACKTEST = """backtest as (
  select system, exit_date as date,
         cast(1000000 + sum(sum(pl)) over (partition by system order by exit_date rows unbounded preceding)
              as double) as equity
  from trades group by system, exit_date)"""

_PERIODS = """periods as (
  select * from (values ('current_month', date '2000-11-30'), ('2_months', date '2000-10-31'),
                        ('3_months', date '2000-09-30'), ('ytd', date '1999-12-31'),
                        ('all', date '1994-12-31')) as p(period, date_from))"""

_DAY_TOTALS = """closed as (select exit_date as date, sum(pl) as pl_closed from trades group by 1),
opened as (select date, sum(pl) as pl_open from open_pl group by 1)"""


def _with(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


_PORTFOLIO = (_TRADES, _OPEN, _BARS, _CALENDAR, _DAY_TOTALS, _PERIODS)


def _days(date_from: str) -> str:
    return f"""days as (
  select c.date, pl_closed, coalesce(pl_open, 0) as pl_open, b.close
  from calendar c left join closed using (date) left join opened using (date) left join bars b using (date)
  where c.date > date '{date_from}' and c.date <= date '2000-12-31')"""


_PERIOD_DAYS = """days as (
  select period, c.date, pl_closed, coalesce(pl_open, 0) as pl_open, b.close
  from calendar c join periods on c.date > date_from and c.date <= date '2000-12-31'
       left join closed using (date) left join opened using (date) left join bars b using (date))"""


def _previous(join: str, group: str) -> str:
    return f"""numbered as (select date, close, row_number() over (order by date) as n from bars),
base as (
  select {group} arg_min(p.close, t.date) as base_close
  from numbered t join numbered p on t.n - 1 = p.n {join})"""


def _base(date_from: str) -> str:
    return _previous(f"where t.date > date '{date_from}' and t.date <= date '2000-12-31'", "")


_BASE_PERIODS = _previous(
    "join periods on t.date > date_from and t.date <= date '2000-12-31' group by period", "period,")


def _p_ret(over: str) -> str:
    return f"""round((cast(1000000 + sum(pl_closed) over ({over} rows unbounded preceding) + pl_open as double)
             / 1000000 - 1) * 100, 8) as p_ret_pct"""


_BENCH = "round((cast(close as double) / cast(base_close as double) - 1) * 100, 8)"


def _months(group: str) -> str:
    return f"""months as (
  select {group} strftime(date, '%Y-%m') as ym, sum(pl_closed) + arg_max(pl_open, date) as total,
         arg_max_null(close, date) as close
  from days group by all)"""


def _cum_month(over: str) -> str:
    return f"round(cast(sum(total) over ({over} rows unbounded preceding) as double) / 1000000 * 100, 8) as cum_ret_p_pct"


_MONTHLY = _with(*_PORTFOLIO, _days("1994-12-31"), _months("")) + f"select ym, {_cum_month('order by ym')} from months"


def _system_pl(chosen: str) -> str:
    return f"""pl as (
  select date, system, cast(sum(c) as decimal(28,4)) as pl_closed, cast(sum(o) as decimal(28,4)) as pl_open
  from (select exit_date as date, system, pl as c, 0 as o from trades
        union all select date, system, 0, pl from open_pl)
  where date > date '1994-12-31' and date <= date '2000-12-31' and system in ({chosen})
  group by 1, 2)"""


_ALL = "select distinct system from trades"
_SELECTED = "'1-URGENT', '3-MEDIUM'"

_EQUITY = """grid as (select date, system from (select distinct date from pl), (select distinct system from pl)),
equity as (
  select date, system,
         cast(sum(coalesce(pl_closed, 0)) over (partition by system order by date rows unbounded preceding)
              + coalesce(pl_open, 0) + 200000 as double) as equity
  from grid left join pl using (date, system))"""

_DD = """dd as (
  select date, system,
         (equity / max(equity) over (partition by system order by date rows unbounded preceding) - 1) * 100 as dd_pct
  from equity)"""

_SYSTEMS = (_TRADES, _OPEN, _system_pl(_ALL), _EQUITY)

_CURRENT = """marked as (
  select *, row_number() over w as n, dd_pct < 0 and lag(dd_pct) over w = 0 as starts
  from dd window w as (partition by system order by date)),
current as (
  select system, coalesce(max(n) - max(n) filter (starts) + 1, 0) as dd_days,
         abs(arg_max(dd_pct, date)) as dd_pct, arg_max(dd_pct, date) < 0 as is_underwater
  from marked group by system)"""


def _rolling(condition: str) -> str:
    return f"""live as (select system from dd where {condition} group by system having sum(dd_pct) <> 0),
series as (select dd.* from dd join live using (system)),
pair as (
  select a.date, a.system as sa, b.system as sb,
         case when count(*) over w = 60 and max(a.dd_pct) over w > min(a.dd_pct) over w
                   and max(b.dd_pct) over w > min(b.dd_pct) over w
              then case when a.system = b.system then 1 else corr(a.dd_pct, b.dd_pct) over w end end as c
  from series a join series b on a.date = b.date
  window w as (partition by a.system, b.system order by a.date rows between 59 preceding and current row)),
combined as (
  select date, (coalesce(sum(c), 0) - (select count(*) from live)) / 2 / (select count(*) from live) as v,
         row_number() over (order by date) as n
  from pair group by date)
select date, round(v, 4) as combined_corr from combined where n > 60"""


# Products are taken strictly from left to right: a windowed product may associate otherwise.
_CURVES = """numbered as (
  select system, date, equity, row_number() over w - 1 as step, first_value(equity) over w as base,
         coalesce(equity / lag(equity) over w - 1, 0) as change
  from backtest window w as (partition by system order by date)),
placed as (
  select system, run, step, base, change,
         case when run = 0 then step
              else row_number() over (partition by system, run
                                      order by md5(concat('42|', run, '|', system, '|', step)), step) - 1 end as place
  from numbered, (select cast(range as integer) as run from range(101))),
factors as (
  select system, run, any_value(base) as base, list([1 + change] order by place) as fs from placed group by 1, 2),
products as (
  select system, run, base, list_reduce(fs, lambda a, b: list_append(a, a[-1] * b[1])) as ps from factors),
curves as (
  select system, run, cast(unnest(range(len(ps))) as integer) as step, round(base * unnest(ps), 4) as equity from products)"""

_EPISODES = """peaks as (
  select *, max(equity) over (partition by system, run order by step rows unbounded preceding) as equity_high
  from curves),
episodes as (
  select system, run, equity_high, max(abs((equity / equity_high - 1) * 100)) as pct, count(*) as days
  from peaks where equity < equity_high group by 1, 2, 3)"""

_RESAMPLED = (_TRADES, _BACKTEST, _CURVES)


def _worst(metric: str) -> str:
    return f"""ranked as (
  select system, cast({metric} as double) as v, row_number() over (partition by system order by {metric} desc) as n
  from episodes),
worst as (
  select system, '{metric}' as metric, round(max(v), 8) as worst_1, round(min(v), 8) as worst_n
  from ranked where n <= 10 group by system)"""


def _distribution(metric: str) -> str:
    return (_with(*_SYSTEMS, _DD, _CURRENT, _BACKTEST, _CURVES, _EPISODES, _worst(metric))
            + f"""select worst.system, metric, round(cast(dd_{metric} as double), 8) as current, worst_n, worst_1
from worst left join current using (system)""")


def _seeded(seed: int) -> str:
    return (_with(_TRADES, _BACKTEST, _CURVES.replace("'42|'", f"'{seed}|'"), _EPISODES)
            + "select system, run, equity_high, round(pct, 8) as pct, days from episodes")


_REFRESHED = (f"select * from ({_seeded(42)}) where system <> '2-HIGH' union all "
              f"select * from ({_seeded(43)}) where system = '2-HIGH'")

_WIDE = ", ".join(f"""round(max(equity) filter (system = '{s}'), 8) as "{s}\""""
                  for s in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))

_BLOTTER_COLUMNS = ("trade_id, system, action, ticker, entry_date, entry_price, quantity, commission, exit_date, pl")

ORACLES = {
    "business_calendar": _with(_BARS, _CALENDAR)
    + "select date, cast(month(date) as int) as month, cast(year(date) as int) as year from calendar",

    "period_bounds": _with(_BARS, _CALENDAR) + """
select 'current_month' as period, cast(date_trunc('month', date) - interval 1 day as date) as date_from, date as date_to
from calendar
union all select '2_months', cast(date_trunc('month', date) - interval 1 month - interval 1 day as date), date
from calendar
union all select '3_months', cast(date_trunc('month', date) - interval 2 month - interval 1 day as date), date
from calendar
union all select 'ytd', cast(date_trunc('year', date) - interval 1 day as date), date from calendar
union all select 'all', date '1994-12-31', date from calendar""",

    "daily_closed_pl": _with(_TRADES) + "select exit_date as date, cast(sum(pl) as decimal(28,4)) as pl_closed from trades group by 1",

    "daily_open_pl": _with(_OPEN)
    + "select date, cast(sum(pl) as decimal(28,4)) as pl_open from open_pl group by 1",

    "table_counts": _with(_TRADES, _OPEN, _BARS, _BACKTEST) + """
select 'trades' as table_name, count(*) as row_count from trades
union all select 'open_pl', count(*) from open_pl
union all select 'bars', count(*) from bars
union all select 'backtest', count(*) from backtest""",

    "daily_equity": _with(*_PORTFOLIO, _days("1994-12-31")) + f"select date, {_p_ret('order by date')} from days",

    "daily_equity_ytd": _with(*_PORTFOLIO, _days("1999-12-31")) + f"select date, {_p_ret('order by date')} from days",

    "daily_equity_all_periods": _with(*_PORTFOLIO, _PERIOD_DAYS)
    + f"select period, date, {_p_ret('partition by period order by date')} from days",

    "benchmark_base": _with(_BARS, _base("1999-12-31")) + "select base_close from base",

    "daily_equity_vs_benchmark": _with(*_PORTFOLIO, _days("1994-12-31"), _base("1994-12-31"))
    + f"select date, {_p_ret('order by date')}, {_BENCH} as bench_ret_pct from days, base",

    "daily_equity_vs_benchmark_all_periods": _with(*_PORTFOLIO, _PERIOD_DAYS, _BASE_PERIODS)
    + f"""select period, date, {_p_ret('partition by period order by date')}, {_BENCH} as bench_ret_pct
from days left join base using (period)""",

    "monthly_returns": _MONTHLY,

    "monthly_returns_vs_benchmark": _with(*_PORTFOLIO, _days("1994-12-31"), _base("1994-12-31"), _months(""))
    + f"select ym, {_cum_month('order by ym')}, {_BENCH} as cum_ret_bench_pct from months, base",

    "monthly_returns_all_periods": _with(*_PORTFOLIO, _PERIOD_DAYS, _months("period,"))
    + f"select period, ym, {_cum_month('partition by period order by ym')} from months",

    "monthly_returns_vs_benchmark_all_periods": _with(*_PORTFOLIO, _PERIOD_DAYS, _BASE_PERIODS, _months("period,"))
    + f"""select period, ym, {_cum_month('partition by period order by ym')}, {_BENCH} as cum_ret_bench_pct
from months left join base using (period)""",

    "monthly_table": f"""select ym, cast(cast(cast(cum_ret_p_pct as decimal(38,12)) as decimal(38,2)) as varchar)
       as cum_ret_p_pct from ({_MONTHLY})""",

    "system_list": _with(_TRADES) + "select distinct system from trades",

    "system_daily_pl": _with(_TRADES, _OPEN, _system_pl(_ALL)) + "select * from pl",

    "system_daily_pl_selected": _with(_TRADES, _OPEN, _system_pl(_SELECTED)) + "select * from pl",

    "system_equity_abs": _with(*_SYSTEMS) + "select date, system, round(equity, 8) as equity from equity",

    "system_equity_abs_selected": _with(_TRADES, _OPEN, _system_pl(_SELECTED), _EQUITY)
    + "select date, system, round(equity, 8) as equity from equity",

    "system_equity_pct": _with(*_SYSTEMS) + """
select date, system,
       round((equity / first_value(equity) over (partition by system order by date) - 1) * 100, 8) as ret_pct
from equity""",

    "system_equity_wide": _with(*_SYSTEMS) + f"select date, {_WIDE} from equity group by date",

    "system_correlation": _with(*_SYSTEMS) + """
select a.system as system_a, b.system as system_b, round(corr(a.equity, b.equity), 6) as corr
from equity a join equity b using (date) group by 1, 2""",

    "system_correlation_uneven": _with(_TRADES, _BACKTEST) + """
select a.system as system_a, b.system as system_b, round(corr(a.equity, b.equity), 6) as corr
from backtest a join backtest b using (date) group by 1, 2""",

    "trade_blotter": _with(_TRADES)
    + f"select {_BLOTTER_COLUMNS} from trades where entry_date > date '1999-12-31' order by trade_id desc",

    "trade_blotter_selected": _with(_TRADES) + f"""
select {_BLOTTER_COLUMNS} from trades
where system in ({_SELECTED}) and entry_date > date '1994-12-31' order by trade_id desc""",

    "daily_pct_change": _with(_TRADES, _BACKTEST) + """
select date, system,
       round((equity / lag(equity) over (partition by system order by date) - 1) * 100, 8) as pct_change
from backtest""",

    "underwater": _with(*_SYSTEMS, _DD) + "select date, system, round(dd_pct, 8) as dd_pct from dd",

    "underwater_selected": _with(*_SYSTEMS, _DD)
    + f"select date, system, round(dd_pct, 8) as dd_pct from dd where system in ({_SELECTED})",

    "current_drawdown": _with(*_SYSTEMS, _DD, _CURRENT)
    + "select system, dd_days, round(dd_pct, 8) as dd_pct, is_underwater from current",

    "risk_key_metrics": _with(*_SYSTEMS, _DD, _CURRENT) + """
select system, cast(floor(cast(round(dd_pct, 8) as decimal(18,8)) * 100) as double) / 100 as dd_size, dd_days
from current""",

    "rolling_dd_correlation": _with(*_SYSTEMS, _DD, _rolling("true")),

    "rolling_dd_correlation_active": _with(*_SYSTEMS, _DD, _rolling("system <> '2-HIGH'")),

    "backtest_systems": _with(_TRADES, _BACKTEST) + "select distinct upper(system) as system from backtest",

    "permutation_resample": _with(*_RESAMPLED) + "select system, run, step, equity from curves",

    "drawdown_episodes": _with(*_RESAMPLED, _EPISODES)
    + "select system, run, equity_high, round(pct, 8) as pct, days from episodes",

    "drawdown_episodes_merged": _with(*_RESAMPLED, _EPISODES) + """
select system, arg_max(run, (pct, -run)) as run, equity_high, round(max(pct), 8) as pct, cast(sum(days) as bigint) as days
from episodes group by system, equity_high""",

    "drawdown_episodes_by_depth": _with(*_RESAMPLED, _EPISODES)
    + "select system, run, equity_high, round(pct, 8) as pct, days from episodes order by pct desc",

    "worst_drawdowns_pct": _with(*_RESAMPLED, _EPISODES, _worst("pct")) + "select * from worst",

    "worst_drawdowns_days": _with(*_RESAMPLED, _EPISODES, _worst("days")) + "select * from worst",

    "drawdown_vs_resample": _distribution("pct"),

    "drawdown_vs_resample_days": _distribution("days"),

    "load_trades": _with(_TRADES) + """
select trade_id, system, action, ticker, entry_date, entry_price, quantity, commission, exit_date,
       cast(null as double) as exit_price, pl from trades""",

    "load_bars": _with(_BARS) + """
select date, cast(open as double) as open, cast(high as double) as high, cast(low as double) as low,
       cast(close as double) as close, cast(month(date) as int) as month, cast(year(date) as int) as year from bars""",

    "backtest_unpivot": _with(_TRADES, _BACKTEST) + """
select d.date, s.system, equity
from (select distinct date from backtest) d cross join (select distinct system from backtest) s
     left join backtest b on b.date = d.date and b.system = s.system""",

    "open_pl_from_wide": _with(_OPEN) + """
select date, system, action, ticker, 0.0::double as entry_price, qty, 0.0::double as closing_price, pl from open_pl""",

    "csv_export_roundtrip": _MONTHLY,

    "table_roundtrip": _with(_OPEN) + "select date, sum(pl) as pl_open from open_pl group by 1",

    "sql_with_parameters": _with(_TRADES) + """
select system, exit_date, cast(sum(pl) as decimal(28,4)) as pl from trades
where exit_date > date '1999-12-31' and exit_date <= date '2000-12-31' group by 1, 2""",

    "load_trades_accepted": _with(_TRADES) + """
select trade_id, system, action, ticker, entry_date, entry_price, quantity, commission, exit_date,
       cast(null as double) as exit_price, pl from trades where trade_id % 13 <> 0 and trade_id % 17 <> 0""",

    "load_trades_rejected": _with(_TRADES) + """
select trade_id, concat_ws(',', case when trade_id % 13 = 0 then 'exit_date' end, case when trade_id % 17 = 0 then 'pl' end) as bad,
       case when trade_id % 13 = 0 then 'someday' else strftime(exit_date, '%-d/%-m/%Y') end as exit_date,
       cast(pl as varchar) || case when trade_id % 17 = 0 then ',0 USD' else '' end as pl
from trades where trade_id % 13 = 0 or trade_id % 17 = 0""",

    "load_trades_counts": _with(_TRADES) + """
select count(*) as rows, count(*) filter (trade_id % 13 = 0 or trade_id % 17 = 0) as rejected,
       count(*) filter (trade_id % 13 = 0) as bad_exit_date, count(*) filter (trade_id % 17 = 0) as bad_pl, 0::bigint as bad_entry_date
from trades""",

    "load_backtest_rejected": _with(_TRADES, _BACKTEST) + """,
cells as (
  select s.system, d.date, day(d.date) = 13 and b.equity is not null as bad
  from (select distinct date from backtest) d cross join (select distinct system from backtest) s
       left join backtest b on b.date = d.date and b.system = s.system)
select system, count(*) filter (not bad) as accepted, nullif(count(*) filter (bad), 0) as rejected,
       (select count(*) from cells where bad) as rejected_in_all
from cells group by system""",

    "backtest_mixed_headers": _with(_TRADES, _BACKTEST) + """,
wanted as (
  select distinct date, s.system
  from backtest, (values ('1-URGENT', false), ('2-HIGH', false), ('3-MEDIUM', true), ('4-NOT SPECIFIED', true), ('5-LOW', true)) s(system, late)
  where date <= date '1996-12-31' or late)
select w.date, w.system, equity from wanted w left join backtest b on b.date = w.date and b.system = w.system""",

    "load_bars_with_blanks": _with(_BARS) + """
select date, cast(open as double) as open, cast(high as double) as high, cast(low as double) as low,
       cast(close as double) as close, cast(month(date) as int) as month, cast(year(date) as int) as year
from bars where day(date) % 10 <> 0""",

    "episodes_refreshed_system": _REFRESHED,

    "episodes_replaced_folder": _REFRESHED,

    "table_rebuilt": _with(_TRADES) + "select exit_date as date, cast(sum(pl) as decimal(28,4)) as pl_closed from trades group by 1",

    "closed_pl_of_stored_range": _with(_TRADES) + """
select exit_date as date, cast(sum(pl) as decimal(28,4)) as pl_closed from trades
where exit_date > date '1996-02-14' and exit_date <= date '1997-08-20' group by 1""",

    "closed_pl_of_stored_days": _with(_TRADES, _BARS, _CALENDAR) + """
select exit_date as date, cast(sum(pl) as decimal(28,4)) as pl_closed from trades
where exit_date in (select date from calendar where month(date) = 3) group by 1""",

    "read_query_text_dates": _with(_TRADES) + "select distinct exit_date as day from trades where exit_date >= date '2000-01-01'",

    "prepare_counts": _with(_TRADES, _OPEN, _BARS, _BACKTEST) + """,
cells as (select (select count(distinct date) from backtest) * (select count(distinct system) from backtest) as n)
select 'trades' as table_name, count(*) as row_count from trades
union all select 'open_pl', count(*) from open_pl
union all select 'bars', count(*) from bars
union all select 'backtest', n from cells
union all select 'curves', n * 11 from cells
union all select 'calendar', count(*) from bars where date >= date '1995-01-01'""",

    "report_portfolio_ytd": _with(*_PORTFOLIO, _days("1999-12-31"), _base("1999-12-31"))
    + f"select date, {_p_ret('order by date')}, {_BENCH} as bench_ret_pct from days, base",

    "report_system_selected": _with(_TRADES, _OPEN, _system_pl(_SELECTED), _EQUITY) + """
select date, system,
       round((equity / first_value(equity) over (partition by system order by date) - 1) * 100, 8) as ret_pct
from equity""",

    "report_risk_points": _with(*_RESAMPLED, _EPISODES)
    + "select system, run, equity_high, round(pct, 8) as pct, days from episodes where system = '3-MEDIUM' order by days desc",

    "report_risk_underwater": _with(*_SYSTEMS, _DD)
    + f"select date, system, round(dd_pct, 8) as dd_pct from dd where system in ({_SELECTED})",

    "report_risk_distribution": f"select * from ({_distribution('days')}) where system = '3-MEDIUM'",

    "drawdown_episodes_segmented": _with(*_RESAMPLED, _EPISODES)
    + "select system, run, equity_high, round(pct, 8) as pct, days from episodes",

    "underwater_segmented": _with(*_SYSTEMS, _DD) + "select date, system, round(dd_pct, 8) as dd_pct from dd",

    "system_correlation_appended": _with(*_SYSTEMS) + """
select a.system as system_a, b.system as system_b, round(corr(a.equity, b.equity), 6) as corr
from equity a join equity b using (date) group by 1, 2""",
}
