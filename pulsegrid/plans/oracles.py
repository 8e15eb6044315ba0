"""DuckDB SQL for the queries that SQL can express, written from the definitions and not from the plans."""

from __future__ import annotations

import numpy as np

from ..functions import kernels

SIG = "sig as (select user_id as signal_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, value as x from events where value is not null)"
XY = f"{SIG}, xy as (select a.signal_id, a.i, a.x, b.x as y from sig a join sig b on a.signal_id = b.signal_id and b.i = a.i + 1)"
NUM = f"{SIG}, num as (select *, count(*) over (partition by signal_id) as n, first_value(x) over (partition by signal_id order by i) as head, last_value(x) over (partition by signal_id order by i rows between unbounded preceding and unbounded following) as tail from sig)"
WAVE = "wave as (select vec_id as row_id, list_transform(embedding, lambda e: cast(e as double)) as v, label from embeddings)"
SPREAD = f"{WAVE}, spread as (select row_id, label, p, v[p + 1] as x from wave, range(0, 64) t(p))"


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def smooth(m: int, source: str = "num", x: str = "x") -> str:
    """Boxcar of m samples (at most n - 1) over rows (signal_id, i, x, n, head, tail)."""
    return f"""select signal_id, i, (coalesce((select sum(b.{x}) from {source} b where b.signal_id = a.signal_id and b.i between a.i - w // 2 and a.i + (w - 1) // 2), 0)
        + greatest(0, w // 2 - i) * head + greatest(0, (w - 1) // 2 - (n - 1 - i)) * tail) / w as x
        from (select *, greatest(1, least({m}, n - 1)) as w from {source}) a"""


def smooth5() -> str:
    return f"{NUM}, flat as ({smooth(5)})"


def tops(source: str, name: str, where: str = "max") -> str:
    cond = {"max": "sign(nx - x) - sign(x - px) < 0", "min": "sign(nx - x) - sign(x - px) > 0", "both": "sign(nx - x) - sign(x - px) <> 0"}[where]
    return f"{name} as (select signal_id, i, x from (select *, lead(x) over w as nx, lag(x) over w as px from {source} window w as (partition by signal_id order by i)) where {cond})"


PEAKS = f"{smooth5()}, {tops('flat', 'peak')}"
RAW = f"{SIG}, {tops('sig', 'peak')}"
LAG3 = "lagged as (select signal_id, i - {0} as i, x from sig where i >= {0})"


def rates(fs: float, source: str = "peak") -> str:
    return f"rate as (select signal_id, i, hr from (select signal_id, i, 60.0 * {fs} / (i - lag(i) over (partition by signal_id order by i)) as hr from {source}) where hr between 40 and 200)"


def spectrum(fs: float, pad: int = 0) -> str:
    return f"""counted as (select *, count(*) over (partition by signal_id) as m, count(*) over (partition by signal_id) + {pad} as n from sig),
    bins as (select *, unnest(range(0, n // 2)) as k from counted),
    dft as (select signal_id, k, max(n) as n, max(m) as m, sum(x * cos(-2.0 * pi() * ((k * i) % n) / n)) as re, sum(x * sin(-2.0 * pi() * ((k * i) % n) / n)) as im from bins group by signal_id, k),
    spec as (select signal_id, k, case when n // 2 > 1 then k * ({fs} / 2.0 / (n // 2 - 1)) else 0.0 end as freq,
        pow(sqrt(re * re + im * im) / m * case when k > 0 then 2.0 else 1.0 end, 2) as power from dft)"""


def welch(fs: float, size: int, step: int, scale: str) -> str:
    return f"""starts as (select signal_id, unnest(range(0, max(i) + 1 - {size} + 1, {step})) as start from sig group by signal_id),
    win as (select s.signal_id, start, i - start as j, x - avg(x) over (partition by s.signal_id, start) as x from starts s join sig on sig.signal_id = s.signal_id and i between start and start + {size - 1}),
    each as (select signal_id, start, k, sum(x * (0.5 - 0.5 * cos(2 * pi() * j / {size})) * cos(-2.0 * pi() * ((k * j) % {size}) / {size})) as re,
        sum(x * (0.5 - 0.5 * cos(2 * pi() * j / {size})) * sin(-2.0 * pi() * ((k * j) % {size}) / {size})) as im
        from win, range(0, {size // 2 + 1}) t(k) group by signal_id, start, k),
    wel as (select signal_id, k, k * {fs} / {size} as freq, avg((re * re + im * im) * {scale} * case when k = 0 or k = {size // 2} then 1 else 2 end) as power from each group by signal_id, k)"""


NORMAL = """{0}w as (select * from (select signal_id, i as start, list(x) over w as v, avg(x) over w as m, stddev_pop(x) over w as s from {1}
    window w as (partition by signal_id order by i rows between current row and 7 following)) where len(v) = 8)"""
Z = "sqrt(abs(16.0 * (1 - (list_dot_product(a.v, b.v) - 8.0 * a.m * b.m) / (8.0 * a.s * b.s))))"


def dist(metric: str) -> str:
    forms = {
        "euclidean": "list_distance(a.v, b.v)",
        "pcosine": "1 - abs(list_cosine_similarity(a.v, b.v))",
        "cityblock": "list_sum(list_transform(range(1, 65), lambda i: abs(a.v[i] - b.v[i])))",
        "chebyshev": "list_max(list_transform(range(1, 65), lambda i: abs(a.v[i] - b.v[i])))",
    }
    return forms[metric]


DBSCAN = f"""with recursive {WAVE}, part as (select * from wave),
    near as (select a.row_id as i, b.row_id as j from part a join part b on a.row_id <> b.row_id where {dist('euclidean')} <= 9.5),
    core as (select row_id from part left join near on row_id = i group by row_id having count(j) + 1 >= 4),
    link as (select i, j from near where i in (from core) and j in (from core)),
    reach(i, j) as (select row_id, row_id from core union select r.i, l.j from reach r join link l on r.j = l.i),
    root as (select i, min(j) as label from reach group by i),
    named as (select i as row_id, label from root union all
        select n.i, min(root.label) from near n join root on n.j = root.i where n.i not in (from core) group by n.i),
    numbered as (select label, dense_rank() over (order by label) - 1 as cluster from (select distinct label from root))"""

KNN = f"""{WAVE}, ranked as (
    select cast(p.label as varchar) as subject, p.row_id as sample_id, cast(t.label as varchar) as claimed, t.row_id as template_id, round(list_distance(p.v, t.v), 6) as d
    from wave p join wave t on p.row_id % 5 = 0 and t.row_id % 5 <> 0),
    thr as (select unnest([8.0::double, 9.5, 11.0, 12.5]) as threshold),
    near as (select * from (select *, row_number() over (partition by subject, sample_id, claimed order by d, template_id) as place from ranked) where place <= 3),
    auth as (select subject, sample_id, claimed, threshold, count(*) filter (d <= threshold) > 1 as accepted from near, thr group by all),
    top as (select * from (select *, row_number() over (partition by subject, sample_id order by d, claimed, template_id) as place from ranked) where place <= 3),
    vote as (select *, row_number() over (partition by subject, sample_id order by n desc, claimed) as best from (select subject, sample_id, claimed, count(*) as n, list(d) as ds from top group by all)),
    ident as (select subject, sample_id, threshold, case when len(list_filter(ds, lambda x: x <= threshold)) > 1 then claimed end as identified from vote, thr where best = 1),
    dec as (select * from auth join ident using (subject, sample_id, threshold)),
    res as (select subject, threshold, count(*) filter (claimed = subject and accepted) as tp, count(*) filter (claimed <> subject and accepted) as fp,
        count(*) filter (claimed <> subject and not accepted) as tn, count(*) filter (claimed = subject and not accepted) as fn,
        count(*) filter (claimed = subject and identified = subject) as h, count(*) filter (claimed = subject and identified <> subject) as m,
        count(*) filter (claimed = subject and identified is null) as r from dec group by subject, threshold)"""


def share(a: str, b: str) -> str:
    return f"({a}) / (case when ({b}) = 0 then 1.0 else cast({b} as double) end)"


AUTH = {
    "acc": share("tp + tn", "tp + tn + fp + fn"), "tar": share("tp", "tp + fn"), "far": share("fp", "tn + fp"), "frr": share("fn", "tp + fn"), "trr": share("tn", "tn + fp"),
    "err": share("fp + fn", "tp + tn + fp + fn"), "ppv": share("tp", "tp + fp"), "fdr": share("fp", "tp + fp"), "npv": share("tn", "tn + fn"), "for": share("fn", "tn + fn"),
    "mcc": share("tp * tn - fp * fn", "sqrt(cast(tp + fp as double) * (tp + fn) * (tn + fp) * (tn + fn))"),
}
ID = {"id_acc": share("h", "h + m + r"), "id_err": share("m + r", "h + m + r"), "mr": share("m", "h + m + r"), "rr": share("r", "h + m + r")}

PARTY = "party as (select event_type as party, round(sum(value), 2) as votes from events group by event_type)"


def averages(divisor: str) -> str:
    return f"""with {PARTY}, q as (select party, j, votes / cast({divisor} as double) as q from party, range(0, 17) t(j))
    select party, count(*) filter (place <= 17) as seats from (select *, row_number() over (order by q desc, party, j) as place from q) group by party"""


SCORES = f"""{SIG}, e as (select signal_id, count(*) as n from sig group by signal_id),
    sc as (select signal_id, ((signal_id * 37) % 101) / 101.0 as q, ((signal_id * 53) % 97) / 97.0 as p, ((signal_id * 11) % 13) / 13.0 * 10 as k, 0.85 + ((signal_id * 7) % 19) / 19.0 * 0.15 as b, n * 1.7 as r from e)"""

SQL = {
    "heart_rate_stats": f"with {PEAKS}, {rates(5.0)} select signal_id, count(*) as n, {r('avg(hr)')} as mean_hr, {r('min(hr)')} as min_hr, {r('max(hr)')} as max_hr from rate group by signal_id",
    "signal_stats": f"""with {SIG}, c as (select *, avg(x) over w as m, median(x) over w as md from sig window w as (partition by signal_id))
        select signal_id, {r('avg(x)', 8)} as mean, {r('median(x)', 8)} as median, {r('min(x)', 8)} as min, {r('max(x)', 8)} as max, {r('max(abs(x - m))', 8)} as max_amp, {r('var_samp(x)', 8)} as var,
        {r('stddev_samp(x)', 8)} as std_dev, {r('avg(abs(x - md))', 8)} as abs_dev, {r('kurtosis(x)', 8)} as kurtosis, {r('skewness(x)', 8)} as skewness from c group by signal_id""",
    "normalize": f"with {SIG} select signal_id, i, {r('(x - avg(x) over w) / stddev_samp(x) over w')} as x from sig window w as (partition by signal_id)",
    "smoother_boxcar": f"with {smooth5()} select signal_id, i, {r('x')} as x from flat",
    "smoother_hamming": f"""with {NUM} select a.signal_id, a.i, {r('0.08 * coalesce(b2.x, head) + 0.54 * coalesce(b1.x, head) + a.x + 0.54 * coalesce(f1.x, tail) + 0.08 * coalesce(f2.x, tail)')} as x
        from num a left join sig b1 on b1.signal_id = a.signal_id and b1.i = a.i - 1 left join sig b2 on b2.signal_id = a.signal_id and b2.i = a.i - 2
        left join sig f1 on f1.signal_id = a.signal_id and f1.i = a.i + 1 left join sig f2 on f2.signal_id = a.signal_id and f2.i = a.i + 2""",
    "smoother_median": f"""with {SIG} select signal_id, i, {r('list_sort(list_resize(list(x) over w, 5, 0.0))[3]')} as x from sig
        window w as (partition by signal_id order by i rows between 2 preceding and 2 following)""",
    "zero_cross": f"with {SIG}, c as (select signal_id, i, sign(x - avg(x) over (partition by signal_id)) as s from sig) select signal_id, i from (select *, lead(s) over (partition by signal_id order by i) as t from c) where s <> t",
    "find_extrema": f"with {SIG}, {tops('sig', 'e', 'both')} select signal_id, i, {r('x')} as x from e",
    "finite_difference": f"with {SIG} select signal_id, i, {r('x')} as x from (select signal_id, i, (lead(x) over w - lag(x) over w) / 2 as x from sig window w as (partition by signal_id order by i)) where x is not null",
    "windower_mean": f"with {SIG}, st as (select signal_id, unnest(range(0, max(i) + 1 - 9, 5)) as start from sig group by signal_id) select st.signal_id, start, {r('avg(x)')} as value from st join sig on sig.signal_id = st.signal_id and i between start and start + 9 group by st.signal_id, start",
    "windower_kernel": f"with {SIG}, st as (select signal_id, unnest(range(0, max(i) + 1 - 4, 5)) as start from sig group by signal_id) select st.signal_id, start, {r('sum(x * [0.0, 0.5, 1.0, 0.5, 0.0][i - start + 1])')} as value from st join sig on sig.signal_id = st.signal_id and i between start and start + 4 group by st.signal_id, start",
    "mean_waves": f"with {SPREAD}, o as (select *, dense_rank() over (order by row_id) - 1 as i from spread), st as (select unnest(range(0, (select max(i) from o) + 1 - 9, 5)) as start) select start, cast(p as integer) as p, {r('avg(x)')} as x from st join o on i between start and start + 9 group by start, p",
    "median_waves": f"with {SPREAD}, o as (select *, dense_rank() over (order by row_id) - 1 as i from spread), st as (select unnest(range(0, (select max(i) from o) + 1 - 9, 10)) as start) select start, cast(p as integer) as p, {r('median(x)')} as x from st join o on i between start and start + 9 group by start, p",
    "heart_rate": f"with {RAW}, {rates(5.0)} select signal_id, i, {r('hr')} as hr from rate",
    "heart_rate_smooth": f"""with {RAW}, {rates(5.0)}, num2 as (select signal_id, i as pos, hr as x, row_number() over w - 1 as i, count(*) over (partition by signal_id) as n,
            first_value(hr) over w as head, last_value(hr) over (partition by signal_id order by i rows between unbounded preceding and unbounded following) as tail from rate window w as (partition by signal_id order by i)),
        fl as ({smooth(3, 'num2')}) select num2.signal_id, pos as i, {r('fl.x')} as hr from num2 join fl on num2.signal_id = fl.signal_id and num2.i = fl.i""",
    "rms_error": f"with {XY} select signal_id, {r('sqrt(avg((x - y) * (x - y)))')} as rmse from xy group by signal_id",
    "pearson": f"with {XY} select signal_id, {r('corr(x, y)')} as r from xy group by signal_id",
    "linear_regression": f"with {XY} select signal_id, {r('regr_slope(y, x)')} as m, {r('regr_intercept(y, x)')} as b from xy group by signal_id",
    "paired_test_stat": f"with {XY} select signal_id, {r('avg(x - y) / (stddev_samp(x - y) / sqrt(count(*)))')} as statistic, count(*) - 1 as df from xy group by signal_id",
    "unpaired_test_stat": f"with {XY} select signal_id, {r('(avg(x) - avg(y)) / sqrt((var_samp(x) + var_samp(y)) / count(*))')} as statistic, 2 * count(*) - 2 as df from xy group by signal_id",
    "synchronize": f"""with {SIG}, {LAG3.format(3)}, a as (select signal_id, i, x - avg(x) over (partition by signal_id) as x from sig), b as (select signal_id, i, x - avg(x) over (partition by signal_id) as x from lagged),
        c as (select a.signal_id, a.i - b.i as lag, round(sum(a.x * b.x), 6) as c from a join b on a.signal_id = b.signal_id group by all)
        select signal_id, lag as delay, {r('c', 4)} as corr from (select *, row_number() over (partition by signal_id order by c desc, lag) as place from c) where place = 1""",
    "power_spectrum": f"with {SIG}, {spectrum(100.0)} select signal_id, k, {r('freq')} as freq, {r('power')} as power from spec",
    "power_spectrum_padded": f"with {SIG}, {spectrum(100.0, 20)} select signal_id, k, {r('freq')} as freq, {r('power')} as power from spec",
    "welch_spectrum": f"with {SIG}, {welch(100.0, 16, 8, '1.0 / 64')} select signal_id, k, {r('freq', 5)} as freq, {r('power * 2', 5)} as power from wel",
    "band_power": f"""with {SIG}, {spectrum(100.0)}, lim as (select *, 10 * log10(power) as db, greatest(5, min(freq) over (partition by signal_id)) as lo, least(20, max(freq) over (partition by signal_id)) as hi from spec)
        select signal_id, {r('10 * log10(avg(pow(10.0, db / 10)))')} as band_power from lim where freq between lo and hi group by signal_id""",
    "find_intersection": f"""with {SIG}, d as (select signal_id, i, x, x - (60.0 - 0.5 * x) as d from sig), n as (select *, lead(d) over w as d1, lead(x) over w as x1 from d window w as (partition by signal_id order by i))
        select signal_id, {r('i + case when d = 0 then 0.0 else d / (d - d1) end')} as x, {r('x + case when d = 0 then 0.0 else d / (d - d1) * (x1 - x) end')} as y from n where d = 0 or (d1 <> 0 and sign(d) <> sign(d1))""",
    "distance_profile": f"with {SIG}, {NORMAL.format('', 'sig')} select a.signal_id, a.start, {r(Z, 5)} as d from w a join w b on a.signal_id = b.signal_id and b.start = 0",
    "matrix_profile_self": f"""with {SIG}, {NORMAL.format('', 'sig')}, p as (select a.signal_id, a.start, b.start as other, round({Z}, 5) as d from w a join w b on a.signal_id = b.signal_id and abs(a.start - b.start) > 2)
        select signal_id, start, d, other as neighbour from (select *, row_number() over (partition by signal_id, start order by d, other) as place from p) where place = 1""",
    "matrix_profile_cross": f"""with {SIG}, {NORMAL.format('', 'sig')}, l as (select signal_id, i - 7 as i, x * x / 100 as x from sig where i >= 7), {NORMAL.format('l', 'l')},
        p as (select a.signal_id, a.start, b.start as other, round({Z}, 5) as d from w a join lw b on a.signal_id = b.signal_id)
        select signal_id, start, d, other as neighbour from (select *, row_number() over (partition by signal_id, start order by d, other desc) as place from p) where place = 1""",
    "car_reference": f"""with c as (select event_type as channel, row_number() over (partition by event_type order by ts, event_id) - 1 as i, value as x from events),
        k as (select * from c where i <= (select min(m) from (select max(i) as m from c group by channel))) select cast(0 as bigint) as signal_id, channel, i, {r('x - avg(x) over (partition by i)')} as x from k""",
    "acc_time_features": f"select l_orderkey, {r('sum(sqrt(l_quantity * l_quantity + l_extendedprice * l_extendedprice + l_discount * l_discount))', 4)} as vm, {r('max((abs(l_quantity) + abs(l_extendedprice) + abs(l_discount)) / 3)', 4)} as sm from lineitem group by l_orderkey",
    "norm_freq": f"with {SIG} select signal_id, i, {r('2 * x / 100')} as w from sig",
    "time_axis": f"with {SIG} select signal_id, i, {r('i / 100.0 * (count(*) over w - 1) / count(*) over w', 9)} as ts from sig window w as (partition by signal_id)",
    "correct_rpeaks": f"""with {PEAKS}, n as (select signal_id, max(i) + 1 as n from sig group by signal_id), j as (select p.signal_id, p.i as r, s.i, s.x from peak p join n using (signal_id) join sig s on s.signal_id = p.signal_id and s.i between p.i - 3 and p.i + 2 where p.i - 3 >= 0 and p.i + 3 <= n)
        select distinct signal_id, i from (select *, row_number() over (partition by signal_id, r order by x desc, i) as place from j) where place = 1""",
    "extract_heartbeats": f"""with {PEAKS}, n as (select signal_id, max(i) + 1 as n from sig group by signal_id)
        select p.signal_id, p.i as r, cast(s.i - p.i + 2 as integer) as p, s.x from peak p join n using (signal_id) join sig s on s.signal_id = p.signal_id and s.i between p.i - 2 and p.i + 3 where p.i - 2 >= 0 and p.i + 4 <= n""",
    "compare_segmentation": f"""with {smooth5()}, {tops('flat', 'test')}, {tops('sig', 'ref')},
        near as (select t.signal_id, t.i, min(abs(t.i - q.i)) as error, arg_min(t.i - q.i, abs(t.i - q.i) * 100000 + q.i) as dev from test t join ref q on t.signal_id = q.signal_id group by t.signal_id, t.i),
        lastm as (select *, error < 2 as hit, last_value(case when error < 2 then i end ignore nulls) over (partition by signal_id order by i rows between unbounded preceding and 1 preceding) as last,
            (i - lag(i) over (partition by signal_id order by i)) / 100.0 as ibi from near),
        c as (select signal_id, count(*) filter (hit) as tp, count(*) filter (not hit and (last is null or i - last > 3)) as fp, avg(dev) filter (hit) as md, stddev_samp(dev) filter (hit) as sd,
            avg(ibi) filter (ibi > 0.3 and ibi < 1.5) as mi, stddev_samp(ibi) filter (ibi > 0.3 and ibi < 1.5) as si from lastm group by signal_id),
        n as (select signal_id, count(*) as n from ref group by signal_id)
        select signal_id, tp, fp, {r('tp / n')} as performance, {r('tp / nullif(tp + fp, 0)')} as acc, {r('fp / nullif(tp + fp, 0)')} as err, {r('md')} as mean_deviation, {r('sd')} as std_deviation, {r('mi')} as mean_ibi, {r('si')} as std_ibi from c join n using (signal_id)""",
    "ssf_segmenter": f"""with {SIG}, f as (select signal_id, i from (select signal_id, i, pow(least(0, lead(x) over (partition by signal_id order by i) - x), 2) as f from sig) where f > 20),
        st as (select signal_id, i as r from (select *, coalesce(lag(i) over (partition by signal_id order by i), 0) as last from f) where i - last > 1), n as (select signal_id, max(i) + 1 as n from sig group by signal_id),
        j as (select st.signal_id, r, s.i, s.x from st join n using (signal_id) join sig s on s.signal_id = st.signal_id and s.i between r - 3 and r + 1 where r + 2 <= n)
        select distinct signal_id, i from (select *, row_number() over (partition by signal_id, r order by x desc, i) as place from j) where place = 1""",
    "bsqi": f"""with {smooth5()}, {tops('flat', 'one')}, {tops('sig', 'two')}, n1 as (select signal_id, count(*) as a from one group by 1), n2 as (select signal_id, count(*) as b from two group by 1),
        h as (select signal_id, count(*) as n from one o where exists (select 1 from two t where t.signal_id = o.signal_id and t.i >= o.i - 2 and t.i < o.i + 2) group by 1)
        select signal_id, {r('2.0 * coalesce(n, 0) / (a + coalesce(b, 0))')} as bsqi from n1 left join n2 using (signal_id) left join h using (signal_id)""",
    "sample_sqi": f"""with {SIG}, d as (select *, abs(x - lag(x) over (partition by signal_id order by i)) as d, avg(x) over (partition by signal_id) as m from sig)
        select signal_id, {r('avg(pow(x - m, 3)) / pow(avg(pow(x - m, 2)), 1.5)', 5)} as ssqi, {r('avg(pow(x - m, 4)) / pow(avg(pow(x - m, 2)), 2) - 3', 5)} as ksqi, {r('100.0 * count(*) filter (d < 20) / count(d)', 5)} as psqi from d group by signal_id""",
    "fsqi": f"""with {SIG}, {welch(100.0, 32, 16, '1.0 / (100.0 * 12)')}, t as (select signal_id, freq, lead(freq) over w as f1, (power + lead(power) over w) / 2 * (lead(freq) over w - freq) as area from wel window w as (partition by signal_id order by freq))
        select signal_id, {r('sum(area) filter (freq >= 5 and f1 <= 20) / sum(area) filter (freq >= 0 and f1 <= 40)', 5)} as fsqi from t group by signal_id""",
    "zz2018_simple": f"""with {SCORES}, l as (select *, case when r < 130 then [0.4, 0.5, 0.8] else [0.3, 0.4, 0.7] end as l from sc),
        g as (select signal_id, [case when q > 0.9 then 2 when q < 0.6 then 0 else 1 end, case when p > l[2] and p < l[3] then 2 when p > l[1] and p < l[2] then 1 else 0 end, case when k > 5 then 2 else 0 end, case when b >= 0.95 then 2 when b < 0.9 then 0 else 1 end] as g from l),
        c as (select signal_id, len(list_filter(g, lambda x: x = 0)) as n0, len(list_filter(g, lambda x: x = 1)) as n1, len(list_filter(g, lambda x: x = 2)) as n2 from g)
        select signal_id, case when n0 >= 3 or (n0 = 2 and n1 >= 1) or (n0 = 1 and n1 = 3) then 'Unacceptable' when n2 >= 3 and n0 = 0 then 'Excellent' else 'Barely acceptable' end as quality from c""",
    "zz2018_fuzzy": f"""with {SCORES}, s as (select signal_id,
            0.4 * case when q <= 0.8 then 0 when q >= 0.9 then q else 1 / (1 + 1 / pow(0.3 * (q * 100 - 80), 2)) end + 0.4 * case when p <= 0.25 then 0 when p >= 0.35 then 1 else 0.1 * (p - 0.25) end + 0.1 * case when k > 5 then 1 else 0 end as a,
            0.4 / (1 + pow((q * 100 - 75) / 7.5, 2)) + 0.4 * case when p < 0.18 or p >= 0.32 then 0 when p < 0.22 then 25 * (p - 0.18) when p < 0.28 then 1 else 25 * (0.32 - p) end + 0.1 as b,
            0.4 * case when q * 100 <= 55 then 1 else 1 / (1 + pow((q * 100 - 55) / 5.0, 2)) end + 0.4 * case when p < 0.15 then 1 when p > 0.25 then 0 else 0.1 * (0.25 - p) end + 0.1 * case when k > 5 then 0 else 1 end + 0.1 / (1 + pow((b - 95) / 2.5, 2)) as c from sc)
        select signal_id, case when (a * a + 2 * b * b + 3 * c * c) / (a * a + b * b + c * c) < 1.5 then 'Excellent' when (a * a + 2 * b * b + 3 * c * c) / (a * a + b * b + c * c) >= 2.4 then 'Unnacceptable' else 'Barely acceptable' end as quality from s""",
    "threshold_edges": f"with {SIG}, a as (select *, x > 60 as up from sig) select signal_id, i from (select *, lag(up) over w as b, lead(up) over w as f from a window w as (partition by signal_id order by i)) where not up and (coalesce(b, false) or coalesce(f, false))",
    "hodges_bui": f"""with {SIG}, m as (select signal_id, i, abs(x - avg(x) over (partition by signal_id)) as x, max(i) over (partition by signal_id) as e from sig),
        z as (select signal_id, i, e, (avg(x) over w - 10) / 8 >= 1.25 as up, count(*) over w as n from m window w as (partition by signal_id order by i rows between current row and 5 following)), k as (select * from z where n = 6)
        select signal_id, least(i + 3, e) as i from (select *, lag(up) over w as b, lead(up) over w as f from k window w as (partition by signal_id order by i)) where not up and (coalesce(b, false) or coalesce(f, false))""",
    "silva": f"""with {SIG}, m as (select signal_id, i, abs(x - avg(x) over (partition by signal_id)) as x from sig),
        z as (select signal_id, i, avg(x) over (partition by signal_id order by i rows between current row and 2 following) as a, avg(x) over w as b, count(*) over w as n from m window w as (partition by signal_id order by i rows between current row and 8 following)),
        f as (select signal_id, i, case when a >= b and a >= 25 then 1 when a < b and a < 25 then 0 end as f from z where n = 9)
        select signal_id, i + 1 as i, case when f = 1 then 'onset' else 'offset' end as kind from (select *, coalesce(lag(f) over (partition by signal_id order by i), 0) as g from f where f is not null) where f <> g""",
    "template_positions": f"""with {WAVE}, x as (select row_id as signal_id, v, list_filter(range(1, len(v) - 1), lambda i: v[i + 1] < v[i] and v[i + 1] < v[i + 2]) as low,
            list_filter(range(1, len(v) - 1), lambda i: v[i + 1] > v[i] and v[i + 1] > v[i + 2]) as high from wave),
        y as (select *, list_max(list_filter(low, lambda i: i < 30)) as q, list_min(list_filter(low, lambda i: i > 30)) as s, list_position(v[1:25], list_max(v[1:25])) - 1 as p, list_position(v[41:], list_max(v[41:])) + 39 as t from x)
        select signal_id, cast(coalesce(q, -1) as integer) as q, cast(coalesce(s, -1) as integer) as s, cast(coalesce(p, -1) as integer) as p, cast(coalesce(t, -1) as integer) as t, cast(coalesce(list_max(list_filter(high, lambda i: i < q)), -1) as integer) as q_start,
            cast(coalesce(list_min(list_filter(high, lambda i: i > s)), -1) as integer) as s_end, cast(coalesce(list_max(list_filter(low, lambda i: i < p)), -1) as integer) as p_start, cast(coalesce(list_min(list_filter(low, lambda i: i > p and i < 25)), -1) as integer) as p_end,
            cast(coalesce(list_max(list_filter(low, lambda i: i >= 30 and i < t)), -1) as integer) as t_start, cast(coalesce(list_min(list_filter(low, lambda i: i > t)), -1) as integer) as t_end from y""",
    "basic_scr": f"""with {SIG}, {tops('sig', 'top')}, {tops('sig', 'low', 'min')},
        f as (select signal_id, min(i) as ft, max(i) as lt, count(*) as nt from top group by signal_id), g as (select signal_id, min(i) as fl, max(i) as ll, count(*) as nl from low group by signal_id),
        c as (select signal_id, case when fl > ft then 1 else 0 end as skip, nl - case when fl > ft then 1 else 0 end as nl, nt - case when lt < ll then 1 else 0 end as nt from f join g using (signal_id)),
        a as (select signal_id, i, row_number() over (partition by signal_id order by i) as k from top), b as (select signal_id, i, row_number() over (partition by signal_id order by i) as k from low),
        m as (select a.signal_id, a.i as t, b.i as l, (a.i + b.i) // 2 as mid from a join c using (signal_id) join b on b.signal_id = a.signal_id and b.k = a.k + c.skip where a.k <= nt - case when nt > nl then 1 else 0 end)
        select m.signal_id, l as onset, mid as peak, {r('p.x - q.x')} as amplitude from m join sig p on p.signal_id = m.signal_id and p.i = mid join sig q on q.signal_id = m.signal_id and q.i = l""",
    "identify_heart_sounds": f"""with {RAW}, g as (select *, i - lag(i) over w as a, lead(i) over w - i as b, row_number() over w as k, count(*) over (partition by signal_id) as n from peak window w as (partition by signal_id order by i)),
        c as (select *, case when a > b then 1 when k > 1 and k < n then 2 end as s from g)
        select signal_id, i, cast(coalesce(s, 3 - lead(s) over w, 3 - lag(s) over w, 1) as integer) as sound from c window w as (partition by signal_id order by i)""",
    "resp_rate": f"""with {SIG}, c as (select signal_id, i, sign(x - avg(x) over (partition by signal_id)) as s from sig), z as (select signal_id, i from (select *, lead(s) over (partition by signal_id order by i) as t from c) where s <> t),
        k as (select signal_id, i from (select *, row_number() over (partition by signal_id order by i) as k from z) where k % 2 = 1) select signal_id, i, {r('rate')} as rate from (select *, 1.0 / (i - lag(i) over (partition by signal_id order by i)) as rate from k) where rate <= 0.35""",
    "avg_heart_rate": f"""with {SIG}, c as (select a.signal_id, b.i - a.i as lag, round(sum(a.x * b.x), 4) as c from sig a join sig b on a.signal_id = b.signal_id and b.i - a.i between 0 and 30 group by all),
        p as (select signal_id, lag as period from (select *, row_number() over (partition by signal_id order by c desc, lag) as place from c where lag between 5 and 28) where place = 1),
        s as (select signal_id, lag + 1 as s from (select c.*, row_number() over (partition by c.signal_id order by c desc, lag) as place from c join p using (signal_id) where lag >= 3 and lag < round_even(period / 2, 0) - 1) where place = 1)
        select signal_id, {r('1200.0 / period')} as heart_rate, {r('coalesce(s, 4) / 20.0')} as systolic from p left join s using (signal_id)""",
    "pdist_euclidean": f"with {WAVE} select a.row_id as i, b.row_id as j, {r(dist('euclidean'), 5)} as d from wave a join wave b on a.row_id < b.row_id",
    "pdist_pcosine": f"with {WAVE} select a.row_id as i, b.row_id as j, {r(dist('pcosine'), 5)} as d from wave a join wave b on a.row_id < b.row_id",
    "cdist_cityblock": f"with {WAVE} select a.row_id as i, b.row_id as j, {r(dist('cityblock'), 5)} as d from wave a join wave b on a.label < 5 and b.label >= 5",
    "squareform": f"with {WAVE} select a.row_id as i, b.row_id as j, {r(dist('chebyshev'), 5)} as d from wave a, wave b",
    "dbscan": f"{DBSCAN} select part.row_id, cast(coalesce(cluster, -1) as integer) as cluster from part left join named using (row_id) left join numbered on numbered.label = named.label",
    "outliers_dbscan": f"{DBSCAN} select part.row_id, case when cluster is null then -1 else 0 end as cluster from part left join named using (row_id) left join numbered on numbered.label = named.label",
    "outliers_dmean": f"""with {SPREAD}, mean as (select list(m order by p) as m from (select p, avg(x) as m from spread group by p)),
        f as (select row_id, list_max(v) as top, list_min(v) as low, list_position(v, list_max(v)) - 1 as place, round(list_distance(v, m), 5) as d from wave, mean),
        u as (select place as usual from f group by place order by count(*) desc, place limit 1), l as (select 1.5 * median(top) as hi, 1.5 * median(low) as lo, avg(d) + 0.5 * stddev_samp(d) as far from f)
        select row_id, case when place <> usual or top > hi or low < lo or d > far then -1 else 0 end as cluster from f, u, l""",
    "mean_distance": f"with {WAVE} select a.row_id, {r('avg(list_distance(a.v, b.v))', 5)} as md from wave a join wave b on true group by a.row_id",
    "mdist_templates": f"""with {WAVE}, md as (select a.label as cluster, a.row_id, round(avg(case when a.row_id = b.row_id then 0.0 else list_distance(a.v, b.v) end), 5) as md from wave a join wave b on a.label = b.label group by all),
        n as (select label as cluster, count(*) as n from wave group by label), q as (select cluster, j, n / cast(j + 1 as double) as q from n, range(0, 20) t(j)),
        s as (select cluster, count(*) filter (place <= 20) as seats from (select *, row_number() over (order by q desc, cluster, j) as place from q) group by cluster)
        select cluster, row_id from (select *, row_number() over (partition by cluster order by md, row_id) as place from md) join s using (cluster) where place <= seats""",
    "centroid_templates": f"with {SPREAD} select label as cluster, cast(p as integer) as p, {r('avg(x)')} as x from spread group by label, p",
    "coassoc": """with e as (select 0 as r, s_suppkey as i, s_nationkey % 3 as c from supplier union all select 1, s_suppkey, s_nationkey % 4 from supplier union all select 2, s_suppkey, cast(floor(s_acctbal / 2500) as integer) from supplier union all select 3, s_suppkey, s_suppkey % 3 from supplier)
        select a.i, b.i as j, count(*) as n from e a join e b on a.r = b.r and a.c = b.c group by a.i, b.i""",
    "extract_clusters": "select cast(label - 1 as integer) as cluster, vec_id as row_id from embeddings",
    "merge_clusters": "select vec_id as row_id, case when label = 0 then -1 else 0 end as cluster from embeddings",
    "knn_authenticate": f"with {KNN} select * from auth",
    "knn_identify": f"with {KNN} select * from ident",
    "subject_results": f"with {KNN} select * from res",
    "assess_classification": f"""with {KNN}, su as (select threshold, subject, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(tn)::bigint as tn, sum(fn)::bigint as fn, sum(h)::bigint as h, sum(m)::bigint as m, sum(r)::bigint as r from res group by rollup (threshold, subject) having threshold is not null)
        select *, {', '.join(f'{r(x)} as "{n}"' for n, x in (AUTH | ID).items())} from su""",
    "misses": f"with {KNN} select threshold, subject, identified, count(*) as n from dec where claimed = subject and identified <> subject group by all",
    "eer": f"""with {KNN}, f as (select subject, threshold, {AUTH['far']} as far, {AUTH['frr']} as frr from res), n as (select *, far - frr as d, lead(far - frr) over w as d1, lead(threshold) over w as t1, lead(far) over w as f1 from f window w as (partition by subject order by threshold)),
        s as (select *, case when d = 0 then 0.0 else d / (d - d1) end as s from n where d = 0 or (d1 <> 0 and sign(d) <> sign(d1)))
        select subject, {r('threshold + s * coalesce(t1 - threshold, 0)')} as threshold, {r('far + s * coalesce(f1 - far, 0)')} as rate from s""",
    "majority_rule": "select user_id, event_type, n from (select *, row_number() over (partition by user_id order by n desc, event_type) as place from (select user_id, event_type, count(*) as n from events group by all)) where place = 1",
    "combination": f"""with v as (select event_type as c, cast(user_id % 7 as varchar) as label, length(event_type) / cast(count(*) over (partition by event_type) as double) as w from events), t as (select label, round(sum(w), 12) as w from v group by label)
        select label, {r('w / (select sum(w) from t)')} as confidence from t order by w desc, label limit 1""",
    "dhondt": averages("j + 1"),
    "sainte_lague": averages("2 * j + 1"),
    "huntington_hill": averages("sqrt((j + 1) * (j + 2))"),
    "largest_remainder": f"""with {PARTY}, q as (select party, votes / (sum(votes) over () / 17.0) as q from party), f as (select *, cast(floor(q) as bigint) as sure, row_number() over (order by round(q - floor(q), 12) desc, party) as place, 17 - sum(floor(q)) over () as rest from q)
        select party, sure + case when place <= rest then 1 else 0 end as seats from f""",
    "iir_filter": f"""with recursive {SIG}, y(signal_id, i, y, z) as (
            select signal_id, i, 0.2 * x + 0.8 * x, 0.8 * (0.2 * x + 0.8 * x) from sig where i = 0
            union all select s.signal_id, s.i, 0.2 * s.x + y.z, 0.8 * (0.2 * s.x + y.z) from y join sig s on s.signal_id = y.signal_id and s.i = y.i + 1)
        select signal_id, i, {r('y')} as x from y""",
    "pipeline_acc": f"""with {SIG}, ax as (select signal_id, i, 'x' as axis, x from sig union all select signal_id, i, 'y', x * 2 from sig union all select signal_id, i, 'z', -x from sig),
        b as (select *, count(*) over (partition by signal_id, axis) as n from ax), k as (select *, unnest(range(0, n // 2)) as k from b)
        select signal_id, axis, k, {r('k * 100.0 / max(n)')} as freq, {r('sqrt(pow(sum(x * cos(-2.0 * pi() * ((k * i) % n) / n)), 2) + pow(sum(x * sin(-2.0 * pi() * ((k * i) % n) / n)), 2)) / max(n)')} as abs_amp from k group by signal_id, axis, k""",
}


# --- kernels, from the definitions ---


def _numbers(xs) -> str:
    return "[" + ", ".join(f"{float(x)!r}::double" for x in np.atleast_1d(xs)) + "]"


BY_TYPE = "typ as (select event_type as signal_id, row_number() over (partition by event_type order by ts, event_id) - 1 as i, value as x from events where value is not null)"


def _filtfilt(taps: str, n: int) -> str:
    """Taps over an odd extension at both ends, forwards and then backwards; before its first sample each pass has that one again."""
    pad = 3 * n
    return f"""with {BY_TYPE}, len as (select signal_id, max(i) + 1 as n, arg_min(x, i) as head, arg_max(x, i) as tail from typ group by signal_id having max(i) + 1 > {pad}),
        ext as (select signal_id, i + {pad} as i, x from typ semi join len using (signal_id)
            union all select t.signal_id, {pad} - t.i, 2 * head - x from typ t join len using (signal_id) where t.i between 1 and {pad}
            union all select t.signal_id, {pad} + n + (n - 2 - t.i), 2 * tail - x from typ t join len using (signal_id) where t.i between n - 1 - {pad} and n - 2),
        taps as (select unnest({taps}) as b, unnest(range(0, {n})) as k),
        ahead as (select e.signal_id, e.i, sum(b * f.x) as x from ext e cross join taps join ext f on f.signal_id = e.signal_id and f.i = greatest(e.i - k, 0) group by all),
        back as (select e.signal_id, e.i, sum(b * f.x) as x from ahead e join len using (signal_id) cross join taps join ahead f on f.signal_id = e.signal_id and f.i = least(e.i + k, n + {2 * pad} - 1) group by all)
        select signal_id, i - {pad} as i, {r('x')} as x from back join len using (signal_id) where i between {pad} and {pad} + n - 1"""


_FIR = kernels.get_filter("FIR", "bandpass", 31, [3, 45], 1000.0)[0]
#: The transform kept at bins 0 and n/2, doubled between and left out above, and turned back.
ANALYTIC = """{0}n as (select *, count(*) over (partition by signal_id) as n from {1}),
    {0}bins as (select *, unnest(range(0, n // 2 + 1)) as k from {0}n),
    {0}dft as (select signal_id, k, max(n) as n, sum(x * cos(-2 * pi() * ((k * i) % n) / n)) as re, sum(x * sin(-2 * pi() * ((k * i) % n) / n)) as im from {0}bins group by signal_id, k),
    {0}z as (select a.signal_id, a.i, sum(h * (re * cos(2 * pi() * ((k * a.i) % a.n) / a.n) - im * sin(2 * pi() * ((k * a.i) % a.n) / a.n))) / any_value(a.n) as re,
        sum(h * (re * sin(2 * pi() * ((k * a.i) % a.n) / a.n) + im * cos(2 * pi() * ((k * a.i) % a.n) / a.n))) / any_value(a.n) as im
        from {0}n a join (select *, case when k = 0 or 2 * k = n then 1 else 2 end as h from {0}dft) d on a.signal_id = d.signal_id group by a.signal_id, a.i)"""


def _student(rows: str) -> str:
    """pv (signal_id, pvalue) of rows (signal_id, t, df): Student's t by its finite series for whole degrees of freedom."""
    return f"""arc as (select signal_id, df, atan(abs(t) / sqrt(df)) as a from ({rows})),
        term as (select signal_id, df, a, j, sum(case when j = 0 then 0.0 when df % 2 = 0 then ln((2 * j - 1) / (2.0 * j)) + 2 * ln(cos(a)) else ln(2.0 * j / (2 * j + 1)) + 2 * ln(cos(a)) end)
            over (partition by signal_id order by j) as l from (select *, unnest(range(0, case when df % 2 = 0 then df // 2 else (df - 1) // 2 end)) as j from arc)),
        pv as (select signal_id, case when df % 2 = 0 then 1 - sin(a) * sum(exp(l)) else 1 - 2 / pi() * (a + sin(a) * cos(a) * sum(exp(l))) end as pvalue from term group by signal_id, df, a)"""


def _response() -> str:
    b, a = kernels.get_filter("cheby2", "lowpass", 4, 8, 100.0)
    part = lambda c, f: f"list_sum(list_transform(range(1, {len(c)} + 1), lambda k: ({_numbers(c)})[k] * {f}(-(k - 1) * w)))"
    return f"""with f as (select j, j * 50.0 / 250 as freq, pi() * j / 250 as w from range(0, 250) t(j)),
        h as (select j, freq, {part(b, 'cos')} as br, {part(b, 'sin')} as bi, {part(a, 'cos')} as ar, {part(a, 'sin')} as ai from f),
        z as (select j, freq, (br * ar + bi * ai) / (ar * ar + ai * ai) as re, (bi * ar - br * ai) / (ar * ar + ai * ai) as im from h),
        p as (select *, atan2(im, re) as angle, atan2(im, re) - lag(atan2(im, re)) over (order by j) as d from z)
        select {r('freq', 5)} as freq, {r('20 * log10(greatest(sqrt(re * re + im * im), 1e-300))', 5)} as magnitude, {r('angle - 2 * pi() * coalesce(sum(round(d / (2 * pi()))) over (order by j), 0)', 5)} as phase from p"""


SIGNS = "bits as (select vec_id as row_id, list_transform(embedding, lambda e: case when e > 0 then 1 else 0 end) as b from embeddings)"
COUNTS = f"""{SIGNS}, cnt as (select x.row_id as i, y.row_id as j, list_sum(list_transform(list_zip(x.b, y.b), lambda p: p[1] * p[2])) as tt, list_sum(x.b) as a, list_sum(y.b) as b from bits x join bits y on x.row_id < y.row_id)"""
_PAIRED, _UNPAIRED = "avg(x - y) / (stddev_samp(x - y) / sqrt(count(*)))", "(avg(x) - avg(y)) / sqrt((var_samp(x) + var_samp(y)) / count(*))"
_R = "greatest(-1.0, least(1.0, corr(x, y)))"
SQL |= {
    "fir_filter": _filtfilt(_numbers(_FIR), len(_FIR)),
    "analytic_signal": f"with {SIG}, {ANALYTIC.format('a', 'sig')} select signal_id, i, {r('sqrt(re * re + im * im)')} as amplitude, {r('atan2(im, re)')} as phase from az",
    "phase_locking": f"""with {SIG}, sq as (select signal_id, i, x * x as x from sig), {ANALYTIC.format('a', 'sig')}, {ANALYTIC.format('b', 'sq')},
        d as (select az.signal_id, atan2(az.im, az.re) - atan2(bz.im, bz.re) as d from az join bz on az.signal_id = bz.signal_id and az.i = bz.i)
        select signal_id, {r('sqrt(avg(cos(d)) ** 2 + avg(sin(d)) ** 2)')} as plf from d group by signal_id""",
    "random_fraction": """select row_id, label, row_number() over (order by md5(concat(row_id, ':0')), row_id) <= floor(count(*) over () * 0.3) as use
        from (select vec_id as row_id, label from embeddings)""",
    "cross_validation": """select row_id, label, cast(split as integer) as split, row_number() over (partition by split, label order by md5(concat(row_id, ':', split, ':0')), row_id) <= greatest(1, round(count(*) over (partition by split, label) * 0.2)) as test
        from (select vec_id as row_id, label, unnest(range(0, 3)) as split from embeddings)""",
    "paired_test": f"with {XY}, st as (select signal_id, {_PAIRED} as t, count(*) - 1 as df from xy group by signal_id), {_student('from st')} select signal_id, {r('t')} as statistic, df, {r('pvalue')} as pvalue from st join pv using (signal_id)",
    "unpaired_test": f"with {XY}, st as (select signal_id, {_UNPAIRED} as t, 2 * count(*) - 2 as df from xy group by signal_id), {_student('from st')} select signal_id, {r('t')} as statistic, df, {r('pvalue')} as pvalue from st join pv using (signal_id)",
    "pearson_test": f"with {XY}, c as (select signal_id, {_R} as r, count(*) - 2 as df from xy group by signal_id), {_student('select signal_id, r * sqrt(df) / sqrt(1 - r * r) as t, df from c')} select signal_id, {r('r')} as r, {r('pvalue')} as pvalue from c join pv using (signal_id)",
    "filter_response": _response(),
    "pdist_jaccard": f"with {COUNTS} select i, j, {r('(a + b - 2 * tt) / cast(a + b - tt as double)')} as d from cnt",
    "pdist_yule": f"with {COUNTS} select i, j, {r('2.0 * (a - tt) * (b - tt) / ((a - tt) * (b - tt) + tt * (64 - a - b + tt))')} as d from cnt",
    "close_pairs": f"with {WAVE} select a.row_id as i, b.row_id as j, {r(dist('euclidean'), 5)} as d from wave a join wave b on a.row_id < b.row_id where {dist('euclidean')} <= 9.5",
    "windower_array": f"""with {SIG}, st as (select signal_id, unnest(range(0, max(i) + 1 - 5, 3)) as start from sig group by signal_id)
        select st.signal_id, start, cast(a.i - start as integer) as p, {r('a.x - b.x')} as value from st join sig a on a.signal_id = st.signal_id and a.i between start and start + 5
        join sig b on b.signal_id = st.signal_id and b.i = 2 * start + 5 - a.i""",
}
SQL["eer"] = SQL["eer"].replace("[8.0::double, 9.5, 11.0, 12.5]", "[2.0::double, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0, 12.0]")
