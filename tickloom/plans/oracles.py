"""The queries' SQL, for DuckDB. Named common table expressions are put together as each query needs them."""

from __future__ import annotations

import re

SYM_FEATURES = ("ret_1b", "ret_5b", "range_vol", "rel_volume")
CUT = 1.0 - 2.0 / 21.0


def text_of(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


def utc_of(hours: str) -> str:
    return f"timezone('UTC', timezone('America/New_York', d + interval '{hours}'))"


def auc_sql(source: str, by: str) -> str:
    """by, num, wp, wn of source(by, score, positive, weight)."""
    return f"""
        select {by}, sum(p * (below + 0.5 * n)) as num, sum(p) as wp, sum(n) as wn from (
            select *, coalesce(sum(n) over (partition by {by} order by score rows between unbounded preceding and 1 preceding), 0) as below from (
                select {by}, score, sum(case when positive then weight else 0 end) as p, sum(case when positive then 0 else weight end) as n
                from {source} group by {by}, score)) group by {by}"""


def cpcv_sql(n_groups: int, k: int, combos: str) -> dict[str, str]:
    return {
        "grouped": f"select l.*, (((i + 1) * {n_groups} - 1) // n)::int as g, n from weighed l join (select sym, count(*) as n from weighed group by sym) using (sym)",
        "combos": combos,
        "tests": """select t.split, t.run, b.* from combos t join (
            select sym, g, min(entry_ts) as a, max(exit_ts) as b, max(i) as last, any_value(n) as n from grouped group by sym, g) b using (g)""",
        "runs": "select sym, split, run, min(a) as a, max(b) as b, max(last) as last, max(last) + greatest(30, ceil(0.01 * any_value(n))) as until from tests group by all",
        "held": "select distinct sym, split, g from tests",
        "members": """select * from (
            select s.split, r.*, case when exists (select 1 from held h where h.sym = r.sym and h.split = s.split and h.g = r.g) then 'test'
                when not exists (select 1 from runs u where u.sym = r.sym and u.split = s.split
                    and ((r.entry_ts <= u.b and r.exit_ts >= u.a) or (r.i > u.last and r.i <= u.until))) then 'train' end as role
            from grouped r join (select distinct sym, split from held) s on s.sym = r.sym) where role is not null""",
    }


def combos_sql(n_groups: int, k: int) -> str:
    from itertools import combinations

    rows = []
    for split, groups in enumerate(combinations(range(n_groups), k)):
        run = -1
        for before, g in zip((None, *groups), groups):
            run += before is None or g != before + 1
            rows.append(f"({split}, {g}, {run})")
    return f"select * from (values {', '.join(rows)}) as t(split, g, run)"


CTES: dict[str, str] = {
    "ev": "select event_type as sym, ts as ets, event_id, 100.0 + value / 100 as price from events",
    "bars": """select sym, time_bucket(interval '15 minutes', ets) as ts, first(price order by ets, event_id) as open, max(price) as high, min(price) as low,
        last(price order by ets, event_id) as close, count(*)::double as volume, count(*) as bar_count, avg(price) as wap from ev group by 1, 2""",
    "cal": f"""select d::date as et_date, {utc_of('4 hours')} as pre_start, {utc_of('9 hours 30 minutes')} as rth_open, {utc_of('16 hours')} as rth_close,
        {utc_of('20 hours')} as post_end from generate_series(timestamp '2023-12-26', timestamp '2024-02-09', interval 1 day) as s(d)
        where isodow(d) < 6 and d::date not in (date '2024-01-01', date '2024-01-15')""",
    "tagged": """select b.*, case when pre_start is null or ts < pre_start then 'OVERNIGHT' when ts < rth_open then 'PRE' when ts < rth_close then 'RTH'
        when ts < post_end then 'POST' else 'OVERNIGHT' end as session, sd, (hour(et) * 60 + minute(et))::bigint as minute_of_day
        from (select *, timezone('America/New_York', timezone('UTC', ts)) as et, timezone('America/New_York', timezone('UTC', ts))::date as sd from bars) b
        left join cal on sd = et_date""",
    "grid": """select g.sym, g.ts, case when pre_start is null or g.ts < pre_start then 'OVERNIGHT' when g.ts < rth_open then 'PRE' when g.ts < rth_close then 'RTH'
        when g.ts < post_end then 'POST' else 'OVERNIGHT' end as session
        from (select sym, unnest(generate_series(min(ts), max(ts), interval 15 minutes)) as ts from bars group by sym) g
        left join cal on timezone('America/New_York', timezone('UTC', g.ts))::date = et_date""",
    "attached": """select g.sym, g.ts, g.session, b.open, b.high, b.low, b.close, b.volume, b.close is not null as is_traded
        from grid g left join bars b on b.sym = g.sym and b.ts = g.ts where g.session in ('PRE', 'RTH', 'POST')""",
    "flagged": """select *, is_gap and count(*) over (partition by sym, run) >= 5 as is_halt from (
            select *, sum(changed) over (partition by sym order by ts) as run from (
                select *, case when is_gap is distinct from lag(is_gap) over (partition by sym order by ts) then 1 else 0 end as changed,
                    lag(close) over (partition by sym order by ts) as before
                from (select *, not is_traded and session = 'RTH' as is_gap from attached)))""",
    "fetched": """select 'TRADES' as series, *, timestamp '2024-02-05 00:00:00' as fetch_ts, 'a' as snapshot_id from bars
        union all select 'TRADES', sym, ts, open, high, low, case when hour(ts) % 4 = 0 then close + 1 else close end, volume, case when hour(ts) = 6 then null else bar_count end, wap,
        timestamp '2024-02-06 00:00:00', 'b' from bars where hour(ts) % 2 = 0""",
    "returned": """select *, lc - lag(lc, 1) over w as r1, lc - lag(lc, 5) over w as r5, lc - lag(lc, 15) over w as r15, lc - lag(lc, 30) over w as r30,
        sqrt(avg(pk) over (w rows between 29 preceding and current row) / (4 * ln(2.0))) as rv,
        case when count(volume) over z >= 2 and stddev_samp(volume) over z > 0 then (volume - avg(volume) over z) / stddev_samp(volume) over z end as zv
        from (select *, case when close > 0 then ln(close) end as lc, case when high > 0 and low > 0 then pow(ln(high / low), 2) end as pk, minute_of_day // 30 as bucket from tagged)
        window w as (partition by sym, sd order by ts), z as (partition by sym, sd order by ts rows between 59 preceding and current row)""",
    "daily": "select sym, sd, bucket, avg(r1 * r1) as rv from returned group by all",
    "ordinal": "select *, row_number() over (partition by sym, bucket order by sd) as k from daily where rv is not null",
    "smooth": f"""select a.sym, a.sd, a.bucket, sum(b.rv * pow({CUT!r}, a.k - b.k)) / sum(pow({CUT!r}, a.k - b.k)) as ewma
        from ordinal a join ordinal b on a.sym = b.sym and a.bucket = b.bucket and b.k <= a.k group by all""",
    "sigmas": """select d.sym, d.sd, d.bucket, sqrt(lag(ewma) over (partition by d.sym, d.bucket order by d.sd)) as sigma
        from daily d left join smooth s on s.sym = d.sym and s.sd = d.sd and s.bucket = d.bucket""",
    "withsigma": "select r.*, sigma from returned r left join sigmas using (sym, sd, bucket)",
    "features": """select sym, ts, session, lag(r1) over w as ret_1b, lag(r5) over w as ret_5b, lag(r15) over w as ret_15b, lag(r30) over w as ret_30b,
        lag(sigma) over w as ewma_vol, lag(rv) over w as range_vol, lag(zv) over w as rel_volume, minute_of_day,
        (session = 'PRE')::bigint as is_pre, (session = 'RTH')::bigint as is_rth, (session = 'POST')::bigint as is_post, bucket
        from withsigma window w as (partition by sym, sd order by ts)""",
    "placed": "select *, row_number() over (partition by sym order by ts) as i from withsigma",
    "decided": """select d.sym, d.i, d.ts as decision_ts, e.ts as entry_ts, d.sigma, e.open as entry, e.open * (1 + 2.0 * d.sigma) as up, e.open * (1 - 2.0 * d.sigma) as down
        from placed d join placed e on e.sym = d.sym and e.i = d.i + 1 where d.sigma > 0 and isfinite(d.sigma) and e.open > 0""",
    "walked": """select d.*, min(case when f.high >= up or f.low <= down then f.i end) as hit, max(f.i) as last
        from decided d join placed f on f.sym = d.sym and f.i between d.i + 1 and d.i + 31 group by all""",
    "labels": """select w.sym, decision_ts, entry_ts, f.ts as exit_ts, (case when hit is null then 0 when f.low <= down then -1 else 1 end)::bigint as label,
        case when hit is null then 'vertical' when f.high >= up and f.low <= down then 'both' when f.low <= down then 'sl' else 'tp' end as touched,
        (case when hit is null then f.close when f.low <= down then down else up end) / entry - 1 as gross_return, w.sigma
        from walked w join placed f on f.sym = w.sym and f.i = coalesce(hit, last)""",
    "dataset": """select l.*, f.session, ret_1b, ret_5b, ret_15b, ret_30b, ewma_vol, range_vol, rel_volume, minute_of_day, is_pre, is_rth, is_post, bucket
        from labels l left join features f on f.sym = l.sym and f.ts = l.decision_ts""",
    "indexed": "select *, row_number() over (partition by sym order by decision_ts) - 1 as i from dataset",
    "windows": """select sym, i, s, greatest(s, e) as e from (
        select a.sym, a.i, least(greatest((select count(*) from indexed b where b.sym = a.sym and b.decision_ts < a.entry_ts), 0), n - 1) as s,
            greatest(least((select count(*) from indexed b where b.sym = a.sym and b.decision_ts <= a.exit_ts) - 1, n - 1), 0) as e
        from indexed a join (select sym, count(*) as n from indexed group by sym) using (sym))""",
    "covered": """select sym, i, sum(d) over (partition by sym order by i) as c from (
        select sym, i, sum(d) as d from (select sym, s as i, 1 as d from windows union all select sym, e + 1, -1 from windows union all select sym, i, 0 from indexed) group by sym, i)""",
    "prefix": "select sym, i, sum(1.0 / greatest(c, 1)) over (partition by sym order by i) as p from covered",
    "weights": """select w.sym, w.i, (pe.p - coalesce(ps.p, 0)) / (w.e - w.s + 1) as weight from windows w join prefix pe on pe.sym = w.sym and pe.i = w.e
        left join prefix ps on ps.sym = w.sym and ps.i = w.s - 1""",
    "weighed": "select x.*, weight from indexed x join weights using (sym, i)",
    "matrix": """select trial, block, round(avg(metric), 12) as metric from (
        select (((i + 1) * 4 - 1) // n)::int as block, unnest([0, 1, 2, 3]) as trial,
            unnest([coalesce(ret_1b, 0) * label, coalesce(ret_5b, 0) * label, coalesce(range_vol, 0) * label, coalesce(rel_volume, 0) * label]) as metric
        from indexed join (select sym, count(*) as n from indexed group by sym) using (sym)) group by trial, block""",
    "halved": """select split, trial, avg(case when block = x or block = y then metric end) as ins, avg(case when block <> x and block <> y then metric end) as oos
        from matrix join (select * from (values (0, 0, 1), (1, 0, 2), (2, 0, 3), (3, 1, 2), (4, 1, 3), (5, 2, 3)) as t(split, x, y)) on true group by split, trial""",
    "ranked": "select sym, bucket, label > 0 as positive, round(coalesce(ret_5b, 0), 9) as score, weight from weighed where label <> 0",
}
CTES |= {
    "permuted": """select sym, b, label, row_number() over (partition by sym, b order by md5(concat_ws('|', concat(sym, '#', b), i, '5')), i) - 1 as place
        from indexed, (select unnest(range(8)) as b)""",
    "members_null": "select m.* replace (concat(m.sym, '#', b) as sym, p.label as label) from members_6_2 m join permuted p on p.sym = m.sym and p.place = m.i",
}


def study_ctes(suffix: str, members: str, features: list[str]) -> dict[str, str]:
    """fits, best, scored and folds of the correlation model over members."""
    return {
        f"fits_{suffix}": "select sym, split, " + ", ".join(f"coalesce(case when isnan(corr({c}, label)) then 0 else corr({c}, label) end, 0) as r{j}" for j, c in enumerate(features))
        + f" from {members} where role = 'train' group by sym, split",
        f"best_{suffix}": "select sym, split, " + "case " + " ".join(f"when round(abs(r{j}), 9) = m then {j}" for j in range(len(features))) + " end as b, case "
        + " ".join(f"when round(abs(r{j}), 9) = m then r{j}" for j in range(len(features))) + f" end as corr from (select *, greatest({', '.join(f'round(abs(r{j}), 9)' for j in range(len(features)))}) as m from fits_{suffix})",
        f"scored_{suffix}": "select * from (select sym, split, bucket, weight, label > 0 as positive, (case when corr >= 0 then 1 else -1 end) * (case b "
        + " ".join(f"when {j} then {c}" for j, c in enumerate(features)) + f" end) as score, count(*) over (partition by sym, split) as n from {members} join best_{suffix} using (sym, split) where role = 'test' and label <> 0) where n >= 2",
        f"folds_{suffix}": f"select sym, split, case when wp > 0 and wn > 0 then num / (wp * wn) end as auc from ({auc_sql(f'scored_{suffix}', 'sym, split')})",
    }


MARKET = [f"coalesce(round({f}, 9), 0)" for f in SYM_FEATURES]
CLOCK = [f"coalesce({f}, 0)::double" for f in ("minute_of_day", "is_pre", "is_rth", "is_post")]
for _n, _k in ((6, 2), (4, 1)):
    CTES |= {f"{name}_{_n}_{_k}": re.sub(r"\b(grouped|combos|tests|runs|held|members)\b", rf"\1_{_n}_{_k}", body) for name, body in cpcv_sql(_n, _k, combos_sql(_n, _k)).items()}
    CTES |= study_ctes(f"{_n}_{_k}", f"members_{_n}_{_k}", MARKET)
CTES |= study_ctes("null", "members_null", MARKET) | study_ctes("clock", "members_6_2", CLOCK) | study_ctes("all", "members_6_2", MARKET + CLOCK)
CTES["null_aucs"] = """select split_part(sym, '#', 1) as sym, split_part(sym, '#', 2)::int as b, auc from (
    select sym, round(avg(auc), 9) as auc from folds_null group by sym) where auc is not null"""


def sql(final: str) -> str:
    """final with the common table expressions that it names, and those that they name."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in need and re.search(rf"\b(from|join)\s+{name}\b", text):
                visit(CTES[name])
                need.append(name)

    visit(final)
    return "with " + ",\n".join(f"{n} as ({CTES[n]})" for n in need) + "\n" + final


def rounded(*names: str, digits: int = 8) -> str:
    return ", ".join(f"round({n}, {digits}) as {n}" for n in names)


TS, DTS = f"{text_of('ts')} as ts", ", ".join(f"{text_of(c)} as {c}" for c in ("decision_ts", "entry_ts", "exit_ts"))
ALL_FEATURES = ("ret_1b", "ret_5b", "ret_15b", "ret_30b", "ewma_vol", "range_vol", "rel_volume")
FLAGS = "minute_of_day, is_pre, is_rth, is_post"
NEAREST = lambda q: f"round(list_sort(list(bps))[floor((count(*) - 1) * {q} + 0.5)::int + 1], 6)"
QUOTES = """select sym, session, (ask - bid) / ((bid + ask) / 2) * 1e4 as bps from (
    select sym, session, close - (close * 0.0005 + (high - low) / 100) as bid, close + (close * 0.0005 + (high - low) / 100) as ask from tagged) where (ask + bid) / 2 > 0 and ask >= bid"""

ORACLES: dict[str, str] = {
    "bars_ohlcv": sql(f"select sym, {TS}, {rounded('open', 'high', 'low', 'close', 'volume', 'wap')}, bar_count from bars"),
    "session_tagged": sql(f"select sym, {TS}, session, minute_of_day, minute_of_day // 30 as bucket from tagged"),
    "session_grid": sql(f"select sym, {TS}, session, is_traded, round(close, 8) as close from attached"),
    "quality_flags": sql(f"""select sym, {TS}, session, is_traded, is_gap, is_halt, is_traded and volume <= 0 as is_zero_volume,
        is_traded and (high < low or low <= 0 or open <= 0 or close <= 0 or coalesce(case when before = 0 then true else abs(close / before - 1) > 0.5 end, false)) as is_price_anomaly from flagged"""),
    "latest_fetch_wins": sql(f"""select sym, series, {TS}, round(close, 8) as close, bar_count, snapshot_id from (
        select *, row_number() over (partition by sym, series, ts order by fetch_ts desc, snapshot_id desc) as n from fetched) where n = 1"""),
    "snapshot_conflicts": sql(f"""select sym, series, {TS}, close, bar_count from (select sym, series, ts, count(distinct close) + max((close is null)::int) as close,
        count(distinct bar_count) + max((bar_count is null)::int) as bar_count from fetched where ts < timestamp '2024-01-25' group by sym, series, ts) where greatest(close, bar_count) > 1"""),
    "lagged_returns": sql(f"select sym, {TS}, {rounded('ret_1b', 'ret_5b', 'ret_15b', 'ret_30b')} from features"),
    "parkinson_vol": sql(f"select sym, {TS}, {rounded('range_vol')} from features"),
    "relative_volume": sql(f"select sym, {TS}, {rounded('rel_volume', digits=6)} from features"),
    "time_of_day": sql(f"select sym, {TS}, {FLAGS} from features"),
    "bucket_ewma_sigma": sql(f"select sym, {TS}, {rounded('sigma')} from withsigma"),
    "feature_matrix": sql(f"select sym, {TS}, session, {rounded(*ALL_FEATURES, digits=6)}, {FLAGS} from features"),
    "asof_context": sql(f"""select sym, {TS}, {text_of('lag(cts) over w')} as ctx_ts, round(lag(cclose) over w, 8) as ctx_close from (
        select t.sym, t.ts, t.sd, c.ts as cts, c.close as cclose from tagged t
        asof left join (select * from bars where sym = (select max(sym) from bars)) c on t.ts >= c.ts) window w as (partition by sym, sd order by ts)"""),
    "triple_barrier": sql(f"select sym, {DTS}, label, touched, {rounded('gross_return', 'sigma')} from labels"),
    "label_distribution": sql("select sym, label, count(*) as n, round(avg(gross_return), 8) as mean_gross_return from labels group by sym, label"),
    "research_dataset": sql(f"select sym, {DTS}, label, touched, session, {rounded('gross_return', *ALL_FEATURES, digits=6)}, {FLAGS} from dataset"),
    "barrier_stats": sql(f"""select sym, n, round(timeout_rate, 8) as timeout_rate, round(barrier_bps, 5) as barrier_bps, round(cross_day_rate, 8) as cross_day_rate,
        round(cost_bps, 6) as cost_bps, round(0.5 * (1 + cost_bps / barrier_bps), 8) as breakeven_1x, round(0.5 * (1 + 2 * cost_bps / barrier_bps), 8) as breakeven_2x
        from (select sym, count(*) as n, avg((touched = 'vertical')::int) as timeout_rate, avg(case when touched <> 'vertical' then abs(gross_return) end) * 1e4 as barrier_bps,
            avg(case when touched <> 'vertical' then (entry_ts::date <> exit_ts::date)::int end) as cross_day_rate from labels group by sym)
        join (select sym, 2 * (0.5 * median(bps) + 1.0 + 0.14 + 0.2) as cost_bps from ({QUOTES}) where session = 'RTH' group by sym) using (sym)"""),
    "spread_by_session": sql(f"""select sym, session, count(*) as n, round(avg(bps), 6) as mean_bps, round(median(bps), 6) as median_bps, {NEAREST(0.25)} as p25_bps,
        {NEAREST(0.75)} as p75_bps, {NEAREST(0.95)} as p95_bps from ({QUOTES}) group by sym, session"""),
    "session_counts": sql(f"select sym, session, count(*) as n, {text_of('min(ts)')} as earliest from tagged group by sym, session"),
    "cpcv_membership": sql("select sym, split, i, role from members_6_2"),
    "uniqueness_weights": sql(f"select sym, {text_of('decision_ts')} as decision_ts, round(weight, 8) as weight from weighed"),
    "effective_sample_size": sql("select sym, count(*) as n, round(sum(weight), 6) as effective_n from weighed group by sym"),
    "weighted_auc": sql(f"select sym, round(num / (wp * wn), 8) as auc from ({auc_sql('ranked', 'sym')}) where wp > 0 and wn > 0"),
    "plain_auc": sql(f"select sym, round(num / (wp * wn), 8) as auc from ({auc_sql('(select * replace (1.0 as weight) from ranked)', 'sym')}) where wp > 0 and wn > 0"),
    "conditional_auc": sql(f"select sym, round(sum(num) / sum(wp * wn), 8) as auc from ({auc_sql('ranked', 'sym, bucket')}) where wp > 0 and wn > 0 group by sym"),
    "tail_accuracy": sql("""select sym, round((sum(case when score >= hi and positive then weight else 0 end) + sum(case when score <= lo and not positive then weight else 0 end))
        / (sum(case when score >= hi then weight else 0 end) + sum(case when score <= lo then weight else 0 end)), 8) as tail_accuracy
        from ranked join (select sym, quantile_cont(score, 0.1) as lo, quantile_cont(score, 0.9) as hi from ranked group by sym) using (sym) group by sym"""),
    "tail_accuracy_by_bucket": sql("""select sym, round((sum(case when score >= hi and positive then weight else 0 end) + sum(case when score <= lo and not positive then weight else 0 end))
        / (sum(case when score >= hi then weight else 0 end) + sum(case when score <= lo then weight else 0 end)), 8) as tail_accuracy
        from ranked join (select sym, bucket, quantile_cont(score, 0.1) as lo, quantile_cont(score, 0.9) as hi, count(*) as k from ranked group by sym, bucket) using (sym, bucket) where k >= 2 group by sym"""),
    "balanced_accuracy": sql("""select sym, round((avg(case when positive then (score > 0)::int end) + avg(case when not positive then (not score > 0)::int end)) / 2, 8) as balanced_accuracy,
        round(avg(((score > 0) = positive)::int), 8) as accuracy from ranked group by sym"""),
    "study_corr_sign": sql("""select sym, round(avg(auc), 8) as auc, round(avg(ba), 8) as balanced_accuracy, round(avg(acc), 8) as accuracy, count(*) as n_paths from folds_6_2 join (
        select sym, split, (avg(case when positive then (score > 0)::int end) + avg(case when not positive then (not score > 0)::int end)) / 2 as ba,
            avg(((score > 0) = positive)::int) as acc from scored_6_2 group by sym, split) using (sym, split) group by sym"""),
    "block_aucs": sql("select s.sym, s.block, round(auc, 8) as auc from (select distinct sym, unnest(range(4))::int as block from weighed) s left join folds_4_1 f on f.sym = s.sym and f.split = s.block"),
    "deflated_prob": sql("select round(pow(avg((round(auc, 9) <= 0.52)::int), 5), 8) as probability from folds_6_2 where auc is not null"),
    "pbo_small": sql("""select round(avg((rank / 5 <= 0.5)::int), 8) as pbo, count(*) as n_splits from (
        select split, sum((o.oos < b.oos)::int) + (sum((o.oos = b.oos)::int) + 1) / 2 as rank from halved o
        join (select split, oos from (select *, row_number() over (partition by split order by ins desc, trial) as k from halved) where k = 1) b using (split) group by split)"""),
    "trial_registry": """select dataset_id, count(*) as tries, count(distinct trial_hash) as trials, min(trial_hash) as first_hash from (
        select event_type as dataset_id, substr(sha256(concat(event_type, '|', user_id % 17)), 1, 16) as trial_hash from events) group by dataset_id""",
    "registry_first_rows": """select dataset_id, trial_hash, event_id from (select event_type as dataset_id, substr(sha256(concat(event_type, '|', user_id % 17)), 1, 16) as trial_hash, event_id,
        row_number() over (partition by event_type, user_id % 17 order by ts, event_id) as k from events) where k = 1""",
    "dataset_id": """select sym, substr(sha256(concat('raw:', string_agg(h, ',' order by h), chr(10), 'bar:15m', chr(10), 'feature:f1', chr(10), 'label:k2h30', chr(10), 'cost:c1', chr(10), 'git:', sym)), 1, 16) as dataset_id
        from (select distinct event_type as sym, substr(sha256(concat(event_type, ts::date::varchar)), 1, 32) as h from events) group by sym""",
    "pacing_budget": f"""select source, {text_of('ts')} as ts, event_id, weight, used from (select *, sum(weight) over (partition by source order by floor(epoch(ts))::bigint range between 599 preceding and current row)::bigint as used from (
        select event_type as source, ts, event_id, (case when event_id % 3 = 0 then 2 else 1 end)::bigint as weight from events))""",
    "systematic_sample": sql(f"""select sym, {text_of('decision_ts')} as decision_ts, label from (select *, row_number() over (partition by sym order by decision_ts) - 1 as k from dataset
        where year(decision_ts) between 2021 and 2025) where k % 15 = 0 and ret_1b is not null and range_vol is not null"""),
    "inner_fold": sql("""select sym, split, fold, count(*) as n from (
        select sym, split, case when back <= nv then 'validation' when entry_ts > b or exit_ts < a then 'inner' else 'purged' end as fold from (
            select *, min(case when back <= nv then entry_ts end) over (partition by sym, split) as a, max(case when back <= nv then exit_ts end) over (partition by sym, split) as b from (
                select *, greatest(1, round_even(0.2 * count(*) over (partition by sym, split), 0)) as nv, row_number() over (partition by sym, split order by i desc) as back
                from members_6_2 where role = 'train'))) group by all"""),
    "stream_bars": sql(f"select sym, {TS}, {rounded('open', 'high', 'low', 'close', 'volume', 'wap')}, bar_count from bars"),
    "lake_round_trip": sql("select sym, label, touched, count(*) as n, round(sum(gross_return), 6) as total from labels where decision_ts >= timestamp '2024-01-10' and decision_ts < timestamp '2024-01-20' group by all"),
    "replay_source": sql("select sym, count(*) as n, round(sum(close), 5) as total from bars where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-12' group by sym"),
    "vendor_times": f"select event_id, {text_of('''timezone('UTC', timezone('America/New_York', ts))''')} as ts from events",
    "lake_whole": sql("select sym, label, touched, count(*) as n, round(sum(gross_return), 6) as total from labels group by all"),
    "replay_whole": sql("select sym, count(*) as n, round(sum(close), 5) as total from bars group by sym"),
    "vendor_times_all": f"select event_id, {text_of('''timezone('UTC', timezone('America/New_York', ts))''')} as ts from events",
    "assembled": sql(f"""select sym, session, count(*) as n, sum(is_traded::int)::bigint as traded, sum(is_gap::int)::bigint as gaps, sum(is_halt::int)::bigint as halts from flagged group by sym, session"""),
}
ORACLES |= {
    "permutation_null": sql("select sym, b, round(auc, 8) as auc from null_aucs"),
    "auc_deflation": sql("""select sym, round(mean, 8) as mean, round(spread, 8) as spread, case when spread >= 0.05 then 'unstable' when mean < 0.5 then 'no_edge'
        when mean > 0.9 then 'edge' else 'ambiguous' end as verdict from (select sym, avg(p) as mean, max(p) - min(p) as spread from (
            select sym, b // 4 as seed, pow(avg((round(auc, 8) <= observed)::int), 4) as p from null_aucs
            join (select sym, round(avg(auc), 8) as observed from folds_6_2 group by sym) using (sym) group by sym, b // 4) group by sym)"""),
    "ablation_shares": sql("""select sym, full_auc, calendar_auc, market_auc, calendar_share, market_share, case when c >= 0.5 * f then 'base_rate' when market_auc >= 0.5 + 0.75 * f then 'conditional_edge' else 'ambiguous' end as verdict from (
        select sym, full_auc, calendar_auc, market_auc, round((calendar_auc - 0.5) / nullif(full_auc - 0.5, 0), 4) as calendar_share,
            round((market_auc - 0.5) / nullif(full_auc - 0.5, 0), 4) as market_share, calendar_auc - 0.5 as c, full_auc - 0.5 as f
        from (select sym, round(avg(auc), 8) as full_auc from folds_all group by sym) join (select sym, round(avg(auc), 8) as calendar_auc from folds_clock group by sym) using (sym)
        join (select sym, round(avg(auc), 8) as market_auc from folds_6_2 group by sym) using (sym))"""),
    "tail_accuracies": sql("""select sym, quantile, round(avg(acc), 8) as tail_accuracy from (
        select sym, split, quantile, (sum(case when score >= hi and positive then weight else 0 end) + sum(case when score <= lo and not positive then weight else 0 end))
            / (sum(case when score >= hi then weight else 0 end) + sum(case when score <= lo then weight else 0 end)) as acc
        from scored_6_2 s join (select sym, split, bucket, 0.1::double as quantile, quantile_cont(score, 0.1) as lo, quantile_cont(score, 0.9) as hi, count(*) as k from scored_6_2 group by all
            union all select sym, split, bucket, 0.25, quantile_cont(score, 0.25), quantile_cont(score, 0.75), count(*) from scored_6_2 group by sym, split, bucket) q using (sym, split, bucket)
        where k >= 2 and n >= 10 group by sym, split, quantile) group by sym, quantile"""),
    "lockbox_touches": """select concat(event_type, '-', user_id) as dataset_id, count(*) as touches, greatest(2 - count(*), 0)::bigint as remaining, count(*) >= 2 as burned
        from events group by 1""",
    "new_trials": f"""select dataset_id, trial_hash, {text_of('min(ts)')} as registered_at from (
        select event_type as dataset_id, substr(sha256(concat(event_type, '|', user_id, '|', hour(ts))), 1, 16) as trial_hash, ts, ts::date >= lo + ((hi - lo) // 2)::int as late
        from events, (select min(ts::date) as lo, max(ts::date) as hi from events)) group by dataset_id, trial_hash having bool_and(late)""",
    "shuffled_labels": sql(f"""select x.sym, {text_of('x.decision_ts')} as decision_ts, y.label from indexed x join (
        select sym, label, row_number() over (partition by sym order by md5(concat_ws('|', sym, i, '11')), i) - 1 as place from indexed) y on y.sym = x.sym and y.place = x.i"""),
    "shuffled_label_blocks": sql(f"""select x.sym, {text_of('x.decision_ts')} as decision_ts, y.label from indexed x join (
        select sym, case when b < k then place * 30 + i % 30 else i end as at, label from (select *, i // 30 as b, count(*) over (partition by sym) // 30 as k from indexed)
        left join (select sym, b, row_number() over (partition by sym order by md5(concat_ws('|', sym, b, '11')), b) - 1 as place
            from (select distinct sym, i // 30 as b, (count(*) over (partition by sym)) // 30 as k from indexed) where b < k) using (sym, b)) y on y.sym = x.sym and y.at = x.i"""),
}
ORACLES["decision_rules"] = f"""with null_rows as ({ORACLES['permutation_null']}) select sym, auc >= null_mean + 3 * null_std as beats_null, tail_accuracy >= breakeven_1x as tail_pays,
    breakeven_2x between 0.55 and 0.57 as floor_holds
    from ({ORACLES['barrier_stats']}) join ({ORACLES['study_corr_sign']}) using (sym) join ({ORACLES['tail_accuracy']}) using (sym)
    left join (select sym, avg(auc) as null_mean, stddev_samp(auc) as null_std from null_rows group by sym) using (sym)"""
