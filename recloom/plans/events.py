"""Spikes are the events table: a unit is a user, times are seconds."""

from __future__ import annotations

from pyspark.sql import functions as F

from recloom.functions.numbers import correlation
from recloom.operators import events as ev
from recloom.operators import steps, tables
from recloom.plans.base import query, t
from recloom.plans.tables import unit_tables
from recloom.sources import writers
from recloom.sources.scratch import folder

HOUR, DAY = 3600.0, 86400.0
E = "e as (select event_id, user_id, event_type, value, epoch_us(ts) / 1e6 tm from events)"


def spikes(s, d):
    return t(s, d, "events").select("event_id", "user_id", "event_type", "value", ev.seconds(F.col("ts")).alias("tm"))


def draw():
    """An order of events that SQL can follow, for draws."""
    return (F.col("event_id") * 7919) % 10007


@query(f"with {E} select event_id, user_id, round(tm - lag(tm) over (partition by user_id order by tm, event_id), 6) isi from e")
def isi_stats(s, d):
    return ev.intervals(spikes(s, d), ["user_id"], "tm", "event_id").select("event_id", "user_id", F.round("isi", 6).alias("isi"))


@query(f"""with {E}, i as (select user_id, tm - lag(tm) over (partition by user_id order by tm, event_id) isi from e), g as (select user_id, min(isi) m, coalesce(min(isi) < 60, false) f from i group by 1)
select c_custkey user_id, round(m, 6) min_isi, f is_contaminated from customer left join g on c_custkey = user_id""")
def contaminated(s, d):
    units = t(s, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return ev.contaminated(spikes(s, d), units, ["user_id"], "tm", "event_id", 60.0).withColumn("min_isi", F.round("min_isi", 6))


@query(f"""with {E}, i as (select *, tm - lag(tm) over (partition by user_id order by tm, event_id) isi from e), j as (select *, lead(isi) over (partition by user_id order by tm, event_id) nxt from i)
select user_id, count(*) n, case when count(*) >= 6 then round((stddev_pop(isi) - avg(isi)) / (stddev_pop(isi) + avg(isi)), 6) end burstiness, case when count(*) >= 6 then round(corr(isi, nxt), 6) end memory from j group by 1""")
def burstiness_memory(s, d):
    x = ev.burstiness_memory(spikes(s, d), ["user_id"], "tm", "event_id")
    return x.withColumns({"burstiness": F.round("burstiness", 6), "memory": F.round("memory", 6)})


@query(f"""with {E}, i as (select *, tm - lag(tm) over (partition by user_id order by tm, event_id) isi from e), j as (select *, lead(isi) over (partition by user_id order by tm, event_id) nxt from i) select round(corr(isi, nxt), 6) memory, count(nxt) n from j""")
def memory_corr(s, d):
    from pyspark.sql import Window

    own = Window.partitionBy("user_id").orderBy("tm", "event_id")
    x = ev.intervals(spikes(s, d), ["user_id"], "tm", "event_id").withColumn("nxt", F.lead("isi").over(own))
    return x.agg(F.round(correlation("isi", "nxt"), 6).alias("memory"), F.count("nxt").alias("n"))


_P = "p as (select a.user_id, b.tm - a.tm lag from e a join e b on a.user_id = b.user_id and b.tm > a.tm and b.tm - a.tm <= 86400)"


@query(f"""with {E}, {_P} select user_id, scale, bin, count(*) n from (select user_id, 'long' as scale, floor(lag / 1800)::bigint bin from p union all select user_id, 'short', floor(lag / 60)::bigint from p where lag <= 3600) group by all""")
def corr_two_scale(s, d):
    return ev.correlograms(spikes(s, d), ["user_id"], "tm", {"long": (1800.0, DAY), "short": (60.0, HOUR)})


_L = "l as (select user_id, least(floor(ln(dd / 60) * 32 / ln(1440.0)), 31)::bigint bin from (select user_id, round_even(lag / 10, 0) * 10 dd from p) where dd >= 60)"


@query(f"with {E}, {_P}, {_L} select user_id, bin, count(*) n from l group by all")
def log_acg(s, d):
    return ev.log_acg(spikes(s, d), ["user_id"], "tm", 10.0, DAY, 32, 60.0)


@query(f"with {E}, {_P}, {_L}, k as (select user_id, count(*) spike_count from e group by 1) select user_id, bin, round(count(*) / any_value(spike_count), 6) rate from l join k using (user_id) group by all")
def acg_normalised(s, d):
    x = spikes(s, d)
    k = x.groupBy("user_id").agg(F.count("*").alias("spike_count"))
    return ev.normalised(ev.log_acg(x, ["user_id"], "tm", 10.0, DAY, 32, 60.0), k, ["user_id"], "n", "spike_count").select("user_id", "bin", F.round("rate", 6).alias("rate"))


@query(f"""with {E}, r as (select *, count(*) over (partition by user_id order by tm range between 43200 preceding and 43200 following) rate from e),
x as (select *, ntile(10) over (partition by user_id order by rate, tm, event_id) decile from r), z as (select user_id, decile, count(*) events from x group by 1, 2),
pr as (select a.user_id, a.decile da, b.decile db, round_even((b.tm - a.tm) / 10, 0) * 10 dd from x a join x b on a.user_id = b.user_id and b.tm > a.tm and b.tm - a.tm <= 86400),
bn as (select *, case when dd >= 60 then least(floor(ln(dd / 60) * 100 / ln(1440.0)), 99)::bigint + 1 else 0 end bin from pr),
u as (select user_id, da decile, bin from bn union all select user_id, db, -bin from bn)
select user_id, decile, bin, count(*) n, round(count(*) / any_value(events), 6) per_event from u join z using (user_id, decile) group by all""")
def acg_by_rate_decile(s, d):
    x = ev.acg_by_rate_decile(spikes(s, d), ["user_id"], "tm", "event_id", 43200.0, 10.0, DAY, 100, 60.0)
    return x.select("user_id", F.col("decile").cast("long").alias("decile"), "bin", "n", F.round("per_event", 6).alias("per_event"))


@query(f"""with {E}, k as (select user_id, count(*) n from e group by 1), tl as (select a.t * 60.0::double tau, l from (select unnest(range(1, 31)) t) a, (select unnest([1, 2, 5, 10, 15, 20]) l) b),
p as (select a.user_id, b.tm - a.tm lag from e a join e b on a.user_id = b.user_id and b.tm > a.tm and b.tm - a.tm <= 1800),
v as (select user_id, t.tau, count(lag) v from k cross join (select distinct tau from tl) t left join p using (user_id) where lag is null or lag < t.tau group by 1, 2),
g as (select k.user_id, n, tau, l, coalesce(v, 0) v, 2 * tau * n * (n / 2592000.0) * (l / 100.0) * (1 - l / 200.0) mean from k cross join tl left join v using (user_id, tau)),
c as (select *, 100 * (1 - list_sum(list_transform(range(0, v + 1), lambda j: exp(j * ln(mean) - mean - lgamma(j + 1))))) conf from g),
b as (select user_id, n, coalesce(max(conf) filter (tau >= 120 and l <= 10), 0) best, arg_min(struct_pack(l := l, tau := tau), l * 1e6 + tau) filter (tau >= 120 and conf >= 70) low, max(v) n_violations from c group by 1, 2)
select user_id, n n_spikes, round(n / 2592000.0, 12) firing_rate, round(best, 6) max_confidence, low.l::double min_contamination, low.tau rp_min, n_violations, best >= 70 passed, best >= 70 or n_violations = 0 forced from b""")
def sliding_rp(s, d):
    x = refractory(s, d)
    return x.withColumns({"firing_rate": F.round("firing_rate", 12), "max_confidence": F.round("max_confidence", 6)})


def refractory(s, d):
    return ev.sliding_rp(spikes(s, d), ["user_id"], "tm", 30 * DAY, [60.0 * k for k in range(1, 31)], [1, 2, 5, 10, 15, 20], rp_reject=120.0)


@query(f"""with {E}, k as (select user_id, count(*) n_spikes from e group by 1), p as (select a.user_id, count(*) n from e a join e b on a.user_id = b.user_id and (b.tm > a.tm or b.tm = a.tm and b.event_id > a.event_id) and b.tm - a.tm < 1800 group by 1)
select user_id, n_spikes, round(n_spikes / 2592000.0, 12) firing_rate, coalesce(n, 0) n_violations from k left join p using (user_id)""")
def refractory_counts(s, d):
    """What the confidences are computed from."""
    return refractory(s, d).select("user_id", "n_spikes", F.round("firing_rate", 12).alias("firing_rate"), "n_violations")


_H = "h as (select floor(tm / 3600)::bigint i, sum(value) v from e group by 1)"


@query(f"""with {E}, {_H}, g as (select i, coalesce(v, 0) v from (select unnest(range((select min(i) from h), (select max(i) + 1 from h))) i) left join h using (i)),
w as (select event_type, floor(tm / 3600)::bigint a from e where floor(tm / 3600) - 5 >= (select min(i) from g) and floor(tm / 3600) + 4 <= (select max(i) from g))
select event_type, o.o::integer as "offset", round(avg(v), 6) v, count(*) n from w, (select unnest(range(-5, 5)) o) o join g on g.i = w.a + o.o group by 1, 2""".replace(", (select unnest(range(-5, 5)) o) o join g", " cross join (select unnest(range(-5, 5)) o) o join g"))
def triggered_average(s, d):
    x = spikes(s, d).withColumn("a", F.floor(F.col("tm") / HOUR))
    return ev.window_average(x, hourly(s, d), [], "a", ["event_type"], -5, 4).withColumn("v", F.round("v", 6))


def hourly(s, d):
    """A signal on an hourly grid: summed values, 0 where nothing was."""
    h = spikes(s, d).groupBy(F.floor(F.col("tm") / HOUR).alias("i")).agg(F.sum("value").alias("v"))
    grid = h.agg(F.min("i").alias("a"), F.max("i").alias("b")).select(F.explode(F.sequence("a", "b")).alias("i"))
    return grid.join(h, "i", "left").select("i", F.coalesce("v", F.lit(0.0)).alias("v"))


@query(f"""with {E}, {_H}, g as (select i, coalesce(v, 0) v from (select unnest(range((select min(i) from h), (select max(i) + 1 from h))) i) left join h using (i)),
k as (select user_id, floor(tm / 3600)::bigint a from e qualify row_number() over (partition by user_id order by (event_id * 7919) % 10007, event_id) <= 256),
w as (select * from k where a - 2 >= (select min(i) from g) and a + 3 <= (select max(i) from g))
select user_id, o.o::integer as "offset", round(avg(v), 6) v, count(*) n from w cross join (select unnest(range(-2, 4)) o) o join g on g.i = w.a + o.o group by 1, 2""")
def cutout_average(s, d):
    x = ev.capped_events(spikes(s, d), ["user_id"], "event_id", draw=draw()).withColumn("a", F.floor(F.col("tm") / HOUR))
    return ev.window_average(x, hourly(s, d), [], "a", ["user_id"], -2, 3).withColumn("v", F.round("v", 6))


@query("select event_type, event_id from events qualify row_number() over (partition by event_type order by (event_id * 7919) % 10007, event_id) <= 256")
def capped_events(s, d):
    """The events drawn, 256 of each type."""
    return ev.capped_events(spikes(s, d), ["event_type"], "event_id", draw=draw()).select("event_type", "event_id")


_C = f"""{E}, b as (select 1 pid, event_type unit, floor(tm / 3600)::bigint i, count(*) n from e group by all), a as (select i, sum(n) al from b group by 1), own as (select unit, sum(n) events from b group by 1),
sp as (select max(i) - min(i) + 1 n_bins, min(i) i0, max(i) i1, sum(n) sum_all from b), v as (select b.* from b, sp where i - 3 >= i0 and i + 3 <= i1), kept as (select unit, sum(n) n_in from v group by 1),
c as (select v.unit, v.n w, o.o::integer off, v.i + o.o j from v cross join (select unnest(range(-3, 4)) o) o),
s as (select c.unit, off, sum(w * (coalesce(al, 0) - coalesce(b.n, 0))) s from c left join a on a.i = j left join b on b.i = j and b.unit = c.unit group by 1, 2),
tr as (select unit, off, s / n_in - (sum_all - events) / n_bins v from s join kept using (unit) join own using (unit), sp)"""


@query(f'with {_C} select unit, off as "offset", round(v, 6) v from tr')
def coupling_trace(s, d):
    return _coupling(s, d).select("unit", "offset", F.round("v", 6).alias("v"))


def _coupling(s, d):
    b = spikes(s, d).groupBy(F.lit(1).alias("pid"), F.col("event_type").alias("unit"), F.floor(F.col("tm") / HOUR).alias("i")).agg(F.count("*").alias("n"))
    return ev.coupling(b, ["pid"], -3, 3)


@query(f"with {_C} select unit, round(arg_min(v, off) filter (off >= 0), 6) strength, round(sum(off * 3600.0 * abs(v)) / sum(abs(v)), 6) delay from tr group by 1")
def coupling_metrics(s, d):
    return ev.coupling_metrics(_coupling(s, d), ["unit"], "offset", "v", HOUR).select("unit", F.round("strength", 6).alias("strength"), F.round("delay", 6).alias("delay"))


@query("select event_id, value, c_name, n_name from events join customer on user_id = c_custkey join nation on c_nationkey = n_nationkey")
def spike_channel(s, d):
    clusters, channels = unit_tables(s, d)
    return tables.attribute_of_unit(t(s, d, "events"), clusters, channels, [], "user_id", "nationkey").select("event_id", "value", "c_name", "n_name")


@query(f"with {E} select user_id, n, burstiness, memory from (select user_id, count(*) n, case when count(*) >= 8 then round((stddev_pop(isi) - avg(isi)) / (stddev_pop(isi) + avg(isi)), 6) end burstiness, case when count(*) >= 8 then round(corr(isi, nxt), 6) end memory from (select *, lead(isi) over (partition by user_id order by tm, event_id) nxt from (select *, tm - lag(tm) over (partition by user_id order by tm, event_id) isi from e)) group by 1)")
def step_by_name(s, d):
    """A step with an option."""
    x = steps.run("burstiness", spikes(s, d), unit=["user_id"], time="tm", tie="event_id", least=8)
    return x.withColumns({"burstiness": F.round("burstiness", 6), "memory": F.round("memory", 6)})


@query(f"""with {E} select a.user_id, a.event_id trial, b.event_type unit, floor((b.tm - (a.tm - 21600)) / 4320)::bigint bin, count(*) n from e a join e b on a.user_id = b.user_id
and a.event_type = 'click' and b.event_type <> 'click' and floor((b.tm - (a.tm - 21600)) / 4320) between 0 and 9 group by 1, 2, 3, 4""")
def trial_counts(s, d):
    """Ten bins around each click, by event type."""
    x = spikes(s, d)
    return ev.trial_counts(x.filter("event_type = 'click'").withColumnRenamed("event_id", "trial"), x.filter("event_type != 'click'"), ["user_id"], "trial", "tm", "event_type", "tm", -6 * HOUR, 1.2 * HOUR, 10)


@query(f"""with {E}, k as (select user_id, count(*) n from e group by 1), p as (select a.user_id, count(*) v from e a join e b on a.user_id = b.user_id and b.tm > a.tm and b.tm - a.tm < 1800 group by 1)
select c_custkey user_id, c_name, n.n slidingRP_n_spikes, case when n.n is not null then coalesce(v, 0) end slidingRP_n_violations from customer left join k n on n.user_id = c_custkey left join p on p.user_id = c_custkey""")
def patched_units(s, d):
    """A stored table of units whose refractory columns are renewed; all others stay."""
    path = folder(s, "units")
    units = t(s, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name", F.lit(-1).alias("slidingRP_n_spikes"), F.lit("old").alias("slidingRP_note"))
    writers.table(units, path)
    options = {"duration": 30 * DAY, "taus": [60.0 * k for k in range(1, 31)], "levels": [1, 2, 5, 10, 15, 20], "rp_reject": 120.0}
    x = steps.run("patch_slidingrp", s.read.parquet(path), spikes(s, d), unit=["user_id"], time="tm", **options)
    return x.select("user_id", "c_name", "slidingRP_n_spikes", "slidingRP_n_violations")
