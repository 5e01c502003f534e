"""Signals: hourly event series, and embeddings as waveforms (a vector's position is a sample or a channel)."""

from __future__ import annotations

from pyspark.sql import functions as F

from recloom.functions import kernels
from recloom.operators import blocks as bk
from recloom.operators import events as ev
from recloom.operators import features as ft
from recloom.operators import signal as sg
from recloom.operators import spikes as sp
from recloom.operators import tables
from recloom.plans.base import query, t
from recloom.plans.events import DAY, HOUR, E, draw, hourly, spikes
from recloom.sources import writers
from recloom.sources.scratch import folder

_G = "h as (select floor(tm / 3600)::bigint i, sum(value) v from e group by 1), g as (select i, coalesce(v, 0) v from (select unnest(range((select min(i) from h), (select max(i) + 1 from h))) i) left join h using (i))"
_X = "x as (select vec_id, label, u.p::integer pos, embedding[u.p + 1]::double v from embeddings, (select unnest(range(64)) p) u)"


def long_vectors(s, d):
    return t(s, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))


_GT = """ht as (select event_type, floor(tm / 3600)::bigint i, sum(value) v from e group by 1, 2), bt as (select event_type, min(i) a, max(i) z from ht group by 1),
g as (select event_type, i, coalesce(v, 0) v from (select event_type, unnest(range(a, z + 1)) i from bt) left join ht using (event_type, i))"""
#: An hour whose sum is over this is saturated.
LIMIT = 120


def grid(s, d):
    return hourly(s, d).select("i")


def hourly_by_type(s, d):
    """A recording per event type: summed values an hour, 0 where nothing was."""
    h = spikes(s, d).groupBy("event_type", F.floor(F.col("tm") / HOUR).alias("i")).agg(F.sum("value").alias("v"))
    g = h.groupBy("event_type").agg(F.min("i").alias("a"), F.max("i").alias("b")).select("event_type", F.explode(F.sequence("a", "b")).alias("i"))
    return g.join(h, ["event_type", "i"], "left").select("event_type", "i", F.coalesce("v", F.lit(0.0)).alias("v"))


@query(f"""with {E}, {_GT}, a as (select e.event_type, least(greatest(ceil(tm / 3600), a), z)::bigint i, sum(value) w from e join bt using (event_type) group by 1, 2)
select g.event_type, g.i, round(coalesce(w, 0), 4) w from g left join a using (event_type, i)""")
def event_to_grid(s, d):
    x = sg.event_to_grid(spikes(s, d), hourly_by_type(s, d).select("event_type", "i"), ["event_type"], "tm", "value", 0.0, HOUR)
    return x.select("event_type", "i", F.round("w", 4).alias("w"))


@query(f"""with {E}, pu as (select event_type, row_number() over (partition by event_type order by tm, event_id) i, tm t from e where event_id % 10 = 0)
select event_id, coalesce((select min(i) from pu where pu.event_type = e.event_type and pu.t >= e.tm), (select max(i) from pu where pu.event_type = e.event_type)) i from e where event_type in (select event_type from pu)""")
def as_of_next(s, d):
    from pyspark.sql import Window

    e = spikes(s, d).select("event_type", "event_id", "tm")
    own = Window.partitionBy("event_type").orderBy("tm", "event_id")
    g = e.filter("event_id % 10 = 0").select("event_type", F.row_number().over(own).cast("long").alias("i"), F.col("tm").alias("t"))
    return sg.as_of_next(e, g, ["event_type"], "tm", width=DAY).select("event_id", "i")


@query(f"""with {E}, sm as (select event_type, tm t, avg(value) v from e group by 1, 2), {_G}, gr as (select event_type, i, i * 3600.0::double t from g cross join (select distinct event_type from sm)),
b as (select gr.*, lo.t t0, lo.v v0 from gr asof left join sm lo on lo.event_type = gr.event_type and gr.t >= lo.t), c as (select b.*, hi.t t1, hi.v v1 from b asof left join sm hi on hi.event_type = b.event_type and b.t <= hi.t)
select event_type, i, round(case when t0 is null then v1 when t1 is null or t1 = t0 then v0 else v0 + (v1 - v0) * (t - t0) / (t1 - t0) end, 4) v from c""")
def resample_grid(s, d):
    sm = spikes(s, d).groupBy("event_type", F.col("tm").alias("t")).agg(F.avg("value").alias("v"))
    g = sm.select("event_type").distinct().join(grid(s, d).select("i", (F.col("i") * HOUR).alias("t")))
    return sg.resample(sm, g, ["event_type"], width=DAY).select("event_type", "i", F.round("v", 4).alias("v"))


@query(f"""with {E}, a as (select event_type, min(tm) g0, max(tm) g1 from e group by 1), b as (select event_type, min(tm) s0, max(tm) s1 from e where value > 95 group by 1)
select event_type, round(coalesce(case when g1 > g0 and s0 is not null then greatest(0, least(g1, s1) - greatest(g0, s0)) / (g1 - g0) end, 0), 9) coverage from a left join b using (event_type)""")
def coverage(s, d):
    x = spikes(s, d)
    return sg.coverage(x.filter("value > 95"), x, ["event_type"], "tm").withColumn("coverage", F.round("coverage", 9))


@query("select event_id, round((value - avg(value) over w) / stddev_pop(value) over w, 6) z from events window w as (partition by event_type)")
def zscore(s, d):
    return sg.zscore(t(s, d, "events").select("event_id", "event_type", "value"), ["event_type"], "value").select("event_id", F.round("z", 6).alias("z"))


@query(f"with {_X}, f as (select vec_id, regr_slope(v, pos) b, regr_intercept(v, pos) a from x group by 1) select vec_id, pos, round(v - a - b * pos, 6) residual from x join f using (vec_id)")
def detrend(s, d):
    return sg.detrend(long_vectors(s, d), ["vec_id"], "pos", "v").select("vec_id", "pos", F.round("residual", 6).alias("residual"))


@query(f"with {_X} select vec_id, (pos // 6)::bigint bin, round(sum(v), 6) v from x where pos < 60 group by 1, 2")
def channel_bin_sum(s, d):
    return sg.channel_bins(long_vectors(s, d), ["vec_id"], "pos", "v", 64, 10).withColumn("v", F.round("v", 6))


@query(f"with {_X} select vec_id, pos, round(v - median(v) over (partition by vec_id), 6) v from x")
def car_subtract(s, d):
    return sg.car(long_vectors(s, d).drop("label"), ["vec_id"], "pos", "v").select("vec_id", F.col("channel").alias("pos"), F.round("v", 6).alias("v"))


@query(f"""with {_X}, bad as (select unnest([3, 4, 40]) pos), good as (select * from x where pos not in (select pos from bad)),
fx as (select vec_id, bad.pos, sum(exp(-abs(g.pos - bad.pos) / 2.0) * v) / sum(exp(-abs(g.pos - bad.pos) / 2.0)) v from bad join good g on abs(g.pos - bad.pos) <= 8 group by 1, 2),
al as (select vec_id, pos, v from good union all select * from fx), md as (select vec_id, median(v) m from good group by 1)
select vec_id, pos, round(v - m, 6) v from al join md using (vec_id)""")
def destripe(s, d):
    bad = s.createDataFrame([(3,), (4,), (40,)], "pos int")
    return sg.car(long_vectors(s, d).drop("label"), ["vec_id"], "pos", "v", bad, 2.0, 1.0).select("vec_id", F.col("channel").alias("pos"), F.round("v", 6).alias("v"))


@query(f"with {_X} select vec_id, pos, round(-(lead(v) over w - 2 * v + lag(v) over w) / 0.04, 4) csd from x window w as (partition by vec_id order by pos)")
def csd(s, d):
    return sg.csd(long_vectors(s, d), ["vec_id"], "pos", "v", 0.2).select("vec_id", "pos", F.round("csd", 4).alias("csd"))


@query(f"with {_X} select label, pos, round(sqrt(avg(v * v)), 6) rms from x group by 1, 2")
def rms_by_channel(s, d):
    return sg.rms(long_vectors(s, d), ["label", "pos"], "v").withColumn("rms", F.round("rms", 6))


@query(f"with {E}, {_GT}, q as (select event_type, i, i - row_number() over (partition by event_type order by i) k from g where v > {LIMIT}) select event_type, min(i) as start, max(i) + 1 as \"end\" from q group by event_type, k")
def saturation_islands(s, d):
    return _bad_spans(s, d).select("event_type", "start", "end")


@query(f"with {_X} select pos, (count(*) filter (abs(v) >= 0.2)) / count(*) > 0.1 saturated from x group by 1")
def saturated_samples(s, d):
    return sg.saturated_samples(long_vectors(s, d).withColumn("k", F.lit(1)), ["k"], "pos", "v", 0.2, 0.1).select("pos", "saturated")


def _bad_spans(s, d):
    return sg.islands(hourly_by_type(s, d), ["event_type"], "i", F.col("v") > LIMIT)


@query(f"""with {E}, {_GT}, q as (select event_type, i, i - row_number() over (partition by event_type order by i) k from g where v > {LIMIT}),
sp as (select event_type, min(i) * 3600.0::double a, (max(i) + 1) * 3600.0::double b from q group by event_type, k)
select event_id from e where not exists (select 1 from sp where sp.event_type = e.event_type and a < tm + 600 and b > tm - 300)""")
def interval_exclusion(s, d):
    spans = _bad_spans(s, d).select("event_type", (F.col("start") * HOUR).alias("start"), (F.col("end") * HOUR).alias("end"))
    e = spikes(s, d).select("event_id", "event_type", "tm")
    return sg.overlapping(e, spans, ["event_type"], "tm", -300.0, 600.0, 4 * HOUR).select("event_id")


@query(f"with {E}, {_GT} select event_type, i, round(case when v > {LIMIT} then 0 else v end, 4) v from g")
def mute(s, d):
    return sg.muted(hourly_by_type(s, d), _bad_spans(s, d), ["event_type"], "i", "v").select("event_type", "i", F.round("v", 4).alias("v"))


@query("select l_orderkey, l_linenumber, case when l_discount >= 0.05 then l_quantity end v from lineitem")
def masked_trace(s, d):
    return sg.masked(t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("v"), "l_discount"), "v", "l_discount", 0.05).drop("l_discount")


_SY = "sy as (select o_custkey, o_orderkey::double s, o_orderkey * 0.004 + 12.5 + (o_orderkey % 7) * 0.00015 tt from orders)"


@query(f"""with {_SY}, f as (select o_custkey, count(*) n, case when count(*) > 1 then regr_slope(tt, s) end slope, case when count(*) > 1 then regr_intercept(tt, s) end ic from sy group by 1)
select o_custkey, round(slope, 7) slope, round(any_value(ic), 4) "intercept", round(max(abs(tt - ic - slope * s)), 7) worst, max(abs(tt - ic - slope * s)) < 0.0004 ok from sy join f using (o_custkey) group by o_custkey, slope""")
def sync_affine(s, d):
    """G27; a customer with one order has no line."""
    k = F.col("o_orderkey")
    x = t(s, d, "orders").select("o_custkey", k.cast("double").alias("s"), (k * 0.004 + 12.5 + (k % 7) * 0.00015).alias("tt"))
    return sg.sync_affine(x, ["o_custkey"], "s", "tt", 0.0004).select("o_custkey", F.round("slope", 7).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("worst", 7).alias("worst"), "ok")


@query("""select p_brand, max(case when p_brand not like '%5' then greatest(abs(p_size - (p_size + case when p_partkey % 400 = 0 then 3 else 0 end)), abs(p_retailprice - p_retailprice)) end)::double dmax,
case when p_brand like '%5' then 'no-map' when max(case when p_partkey % 400 = 0 then 3 else 0 end) > 1 then 'changed' else 'unchanged' end status from part group by 1""")
def geometry_check(s, d):
    p = t(s, d, "part").select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    new = p.filter(~F.col("p_brand").endswith("5")).withColumn("x", F.col("x") + F.when(F.col("p_partkey") % 400 == 0, 3).otherwise(0))
    return sg.geometry_check(p, new, ["p_brand", "p_partkey"], ["x", "y"], 1.0)


@query("""with x as (select vec_id, [z::double for z in embedding] w from embeddings), a as (select *, list_max([abs(z) for z in w]) m from x), p as (select *, list_position([abs(z) for z in w], m) k from a)
select vec_id, (k - 1)::integer peak_time_idx, round(w[k], 6) peak_val, round(case when w[k] < 0 then list_max(w[k:]) else list_min(w[k:]) end, 6) trough_val, round(case when w[k] < 0 then list_max(w[:k]) else list_min(w[:k]) end, 6) tip_val, round(list_max(w) - list_min(w), 6) ptp from p""")
def waveform_features(s, d):
    x = sg.waveform_features(t(s, d, "embeddings"), ["vec_id"], "embedding")
    return x.withColumns({c: F.round(c, 6) for c in ("peak_val", "trough_val", "tip_val", "ptp")})


@query("""with e as (select vec_id, [z::double for z in embedding] w, [abs(z::double) for z in embedding] aw from embeddings),
p as (select *, list_position(aw, list_max(aw)) p, list_max(aw) / 2 half from e), q as (select *, [case when w[p] < 0 then z else -z end for z in w] sw from p),
r as (select *, p - 1 + list_position(sw[p:], list_max(sw[p:])) tr, list_position(sw[:p], list_max(sw[:p])) tip,
  coalesce(list_max(list_filter(range(1, p), lambda j: aw[j] < half)), 0) + 1 a, coalesce(list_min(list_filter(range(p + 1, len(w) + 1), lambda j: aw[j] < half)), len(w) + 1) - 1 b from q),
s as (select *, least(len(w), tr + 16) r from r)
select vec_id, (p - 1)::double peak_time_idx, round(w[p], 6) peak_val, (tr - 1)::double trough_time_idx, round(w[tr], 6) trough_val, (tip - 1)::double tip_time_idx, round(w[tip], 6) tip_val,
  (a - 1)::double half_peak_pre_time_idx, (b - 1)::double half_peak_post_time_idx, (r - 1)::double recovery_time_idx, round(w[r], 6) recovery_val,
  round(case when tip = p then 0 else (w[p] - w[tip]) / (p - tip) * 30000.0 end, 4) depolarisation_slope, round(case when tr = p then 0 else (w[tr] - w[p]) / (tr - p) * 30000.0 end, 4) repolarisation_slope,
  round(case when r = tr then 0 else (w[r] - w[tr]) / (r - tr) * 30000.0 end, 4) recovery_slope from s""")
def waveform_shape(s, d):
    import pandas as pd

    names = list(kernels.waveform_shape([0.0, -1.0, 0.5], 1.0))

    def run(frames):
        for f in frames:
            yield pd.concat([f[["vec_id"]].reset_index(drop=True), pd.DataFrame([kernels.waveform_shape(w, 30_000.0) for w in f["embedding"]], columns=names).astype(float)], axis=1)

    x = t(s, d, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, " + ", ".join(f"{n} double" for n in names))
    return x.withColumns({n: F.round(n, 4 if n.endswith("slope") else 6) for n in names if not n.endswith("idx")})


@query(f"with {_X} select vec_id, pos, (pos + o.o)::integer channel, round(v, 6) v from x cross join (select unnest([-1, 0, 1, 2]) o) o where pos + o.o >= 0 and pos + o.o < 64")
def neighbour_explode(s, d):
    return sg.neighbours(long_vectors(s, d).select("vec_id", "pos", F.round("v", 6).alias("v")), "pos", (-1, 0, 1, 2), 64).drop("slot")


@query("""with x as (select vec_id, label, list_max(embedding) - list_min(embedding) ptp, embedding from embeddings),
p as (select label, vec_id, embedding from x qualify row_number() over (partition by label order by ptp desc, vec_id) = 1)
select label, vec_id, u.i::integer pos, round(embedding[u.i + 1]::double, 6) v from p, (select unnest(range(64)) i) u""")
def peak_trace(s, d):
    """The whole trace."""
    x = sg.peak_traces(t(s, d, "embeddings"), ["label"], "vec_id", "embedding")
    return x.select("label", "vec_id", F.posexplode("trace").alias("pos", "v")).withColumn("v", F.round(F.col("v").cast("double"), 6))


@query("select vec_id, round(list_sum([z::double for z in embedding]) / 64, 6) mean, len(embedding)::integer n, len([z for z in embedding if z > 0.2])::integer detected from embeddings")
def array_summary(s, d):
    total = F.aggregate("embedding", F.lit(0.0), lambda a, z: a + z.cast("double"))
    return t(s, d, "embeddings").select("vec_id", F.round(total / 64, 6).alias("mean"), F.size("embedding").alias("n"), F.size(F.filter("embedding", lambda z: z > 0.2)).alias("detected"))


@query(f"""with {E}, {_GT}, v as (select event_type, i, v, lag(v) over w p, lead(v) over w n from g window w as (partition by event_type order by i))
select event_type, i, round((coalesce(n, v) - coalesce(p, v)) / 3600 / case when p is null or n is null then 1 else 2 end, 8) velocity from v""")
def uniform_trace(s, d):
    return sg.velocity(hourly_by_type(s, d), ["event_type"], "i", "v", 1 / HOUR).select("event_type", "i", F.round("velocity", 8).alias("velocity"))


@query(f"with {_X} select vec_id, 'raw' kind, pos::integer i, round(v, 6) y from x union all select vec_id, 'abs', pos::integer, round(abs(v), 6) from x")
def target_family(s, d):
    x = sg.targets(t(s, d, "embeddings"), ["vec_id"], "vec_id", "embedding", "raw", 250.0).drop("target")
    both = x.unionByName(x.withColumns({"kind": F.lit("abs"), "y": F.abs("y")}))
    return both.withColumn("y", F.round("y", 6))


@query()
def target_bands(s, d):
    """The other family, of every vector and band."""
    return sg.targets(t(s, d, "embeddings"), ["label"], "vec_id", "embedding", "band", 250.0)


@query("""with x as (select vec_id, label, vec_id % 7 ch, sqrt(list_sum([z::double * z::double for z in embedding]) / 64) rms, list_max(embedding)::double top from embeddings)
select label, ch, max(label * 100 + ch)::bigint as place, round(avg(rms), 6) rms_mean, round(median(rms), 6) rms_median, round(avg(top), 6) top_mean, round(median(top), 6) top_median, count(*) n_snippets from x group by 1, 2""")
def probe_tables(s, d):
    """Labels are probes, vectors snippets of seven channels; the merged table."""
    rms = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, z: a + z.cast("double") * z.cast("double")) / 64)
    x = t(s, d, "embeddings").withColumn("ch", F.col("vec_id") % 7).select("label", "ch", (F.col("label") * 100 + F.col("ch")).alias("place"), rms.alias("rms"), F.array_max("embedding").cast("double").alias("top"))
    merged = sg.aggregate_probes(x, "label", "ch", ["place"], ["rms", "top"])[2]
    return merged.withColumns({c: F.round(c, 6) for c in merged.columns if c.endswith(("_mean", "_median"))})


@query("""with x as (select label, [z::double for z in embedding] w from embeddings) select label, round(avg(list_sum(w)), 6) power, count(*) n_windows, count(*) filter (list_max(w) > 0.25) n_detected from x group by 1""")
def spectrum_summary(s, d):
    """Labels are recordings, vectors the spectra of their windows."""
    x = t(s, d, "embeddings").withColumn("hit", F.array_max("embedding") > 0.25)
    return sg.spectrum_summary(x, ["label"], "embedding", "hit").withColumn("power", F.round("power", 6))


@query()
def wheel_trace(s, d):
    """Each user's values on a grid of an hour, low-passed, with their velocity."""
    x = spikes(s, d).groupBy("user_id", F.col("tm").alias("t")).agg(F.avg("value").alias("v"))
    return sg.uniform_trace(x, ["user_id"], HOUR, 0.1 / HOUR)


@query(f"with {_X} select label, pos, round(avg(v), 6) mean, round(median(v), 6) med, count(*) n from x group by 1, 2")
def probe_aggregate(s, d):
    return long_vectors(s, d).groupBy("label", "pos").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.median("v"), 6).alias("med"), F.count("*").alias("n"))


@query(f"""with {_X}, sd as (select vec_id, median(abs(v)) / 0.6745 sd from x group by 1), l as (select *, lag(v) over w p, lead(v) over w n from x join sd using (vec_id) window w as (partition by vec_id order by pos))
select vec_id, pos, round(v, 6) v from l where v < -1.5 * sd and v <= coalesce(p, v) and v < coalesce(n, 'infinity'::double)""")
def spike_detect(s, d):
    return sg.detect_spikes(long_vectors(s, d), ["vec_id"], "pos", "v", 1.5).select("vec_id", "pos", F.round("v", 6).alias("v"))


def _dft(size: int, fs: float) -> str:
    """Powers of Hann windows that overlap by half, by a plain transform, as ``pw`` (vec_id, k: window, f, p)."""
    return f"""x as (select vec_id, u.p::integer pos, embedding[u.p + 1]::double v from embeddings, (select unnest(range(64)) p) u),
w as (select vec_id, k, pos - k * {size // 2} s, v from x, (select unnest(range({(64 - size) // (size // 2) + 1})) k) where pos - k * {size // 2} between 0 and {size - 1}),
c as (select vec_id, k, s, (v - avg(v) over (partition by vec_id, k)) * (0.5 - 0.5 * cos(2 * pi() * s / {size - 1})) y from w),
z as (select sum(power(0.5 - 0.5 * cos(2 * pi() * s / {size - 1}), 2)) e from (select unnest(range({size})) s)),
pw as (select vec_id, k, f.f, (power(sum(y * cos(2 * pi() * f.f * s / {size})), 2) + power(sum(y * sin(2 * pi() * f.f * s / {size})), 2)) / any_value({fs} * e) p from c, (select unnest(range({size // 2 + 1})) f) f, z group by 1, 2, 3)"""


def recordings(s, d):
    """A label's vectors in order are the samples of a recording with 64 channels."""
    from pyspark.sql import Window

    own = Window.partitionBy("label")
    i = F.row_number().over(own.orderBy("vec_id")) - 1
    return t(s, d, "embeddings").select("label", i.cast("long").alias("i"), F.count("*").over(own).alias("n"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))


@query()
def band_envelope(s, d):
    """By blocks of samples with all their channels, floored by the exact median."""
    return bk.log_envelopes(bk.band_amplitudes(recordings(s, d), ["label"], 250.0), ["label"])


@query(f"""with {_dft(32, 250.0)}, m as (select vec_id, f, avg(p) p from pw group by 1, 2),
bn as (select unnest(['delta', 'theta', 'beta', 'gamma']) band, unnest([1.0, 4.0, 15.0, 30.0]) lo, unnest([4.0, 8.0, 30.0, 90.0]) hi)
select vec_id, band, round(10 * log10(avg(p) + 1e-300), 6) db from bn left join m on f * 250.0 / 32 >= lo and f * 250.0 / 32 < hi where vec_id is not null group by 1, 2
union all select vec_id, band, null from embeddings, bn where not exists (select 1 from range(17) f(f) where f.f * 250.0 / 32 >= lo and f.f * 250.0 / 32 < hi)""")
def psd_bands(s, d):
    return sg.band_powers(t(s, d, "embeddings"), ["vec_id"], "embedding", 250.0, 32).withColumn("db", F.round("db", 6))


@query(f"""with {_dft(16, 250.0)}, q as (select vec_id, k, sum(p) q from pw group by 1, 2)
select vec_id, k::integer "window", round(q, 9) power, q > 0.003 and coalesce(lag(q) over (partition by vec_id order by k) <= 0.003, true) detected from q""")
def spectrogram(s, d):
    return sg.spectrogram(t(s, d, "embeddings"), ["vec_id"], "embedding", 250.0, 16, 0.003).withColumn("power", F.round("power", 9))


@query("""with r as (select label, row_number() over (partition by label order by vec_id) - 1 i, count(*) over (partition by label) n, [z::double for z in embedding] e from embeddings),
x as (select label, i, n, c.c, e[c.c + 1] - list_aggregate(e, 'median') v from r, (select unnest(range(64)) c) c),
h0 as (select k, (case when k = 0 then 1 else sin(pi() * 0.4 * k) / (pi() * 0.4 * k) end) * (0.42 + 0.5 * cos(pi() * k / 29) + 0.08 * cos(2 * pi() * k / 29)) h from (select unnest(range(-28, 29)) k)), h as (select k, h / sum(h) over () h from h0),
p as (select label, i, n, i + k a, h from r, h where i % 2 = 0),
s as (select label, i, a src, h w from p where a between 0 and n - 1 union all select label, i, 0, 2 * h from p where a < 0 union all select label, i, least(-a, n - 1), -h from p where a < 0
  union all select label, i, n - 1, 2 * h from p where a >= n union all select label, i, greatest(2 * (n - 1) - a, 0), -h from p where a >= n),
w as (select label, i, src, sum(w) w from s group by 1, 2, 3)
select w.label, w.i // 2 i, x.c::integer channel, round(sum(w * v), 6) v from w join x on x.label = w.label and x.i = w.src group by 1, 2, 3""")
def decimate(s, d):
    """Common reference, low-pass and every second sample, in blocks of 16 with their halo."""
    x = bk.decimated(recordings(s, d), ["label"], 2, 16)
    return x.select("label", "i", F.posexplode("x").alias("channel", "v")).withColumn("v", F.round("v", 6))


@query()
def bad_channels(s, d):
    """Features and labels of every chunk are stored, then each channel's label is what most chunks give it."""
    path = folder(s, "chunk_labels")
    writers.table(bk.chunk_labels(bk.channel_features(recordings(s, d), ["label"], 250.0, 25, window=12).withColumnRenamed("label", "pid"), ["pid"]), path)
    return sg.label_mode(s.read.parquet(path), ["pid", "channel"], "label")


@query("""select l_suppkey, l_linenumber from (select l_suppkey, l_linenumber, count(*) c from lineitem group by 1, 2) qualify row_number() over (partition by l_suppkey order by c desc, l_linenumber) = 1""")
def label_mode(s, d):
    """The most frequent label, the smaller at a tie."""
    return sg.label_mode(t(s, d, "lineitem"), ["l_suppkey"], "l_linenumber")


def gram_packs(s, d):
    """Vectors are samples of 64 channels, labels chunks."""
    x = t(s, d, "embeddings").select("label", F.lit(list(range(64))).alias("c"), F.col("embedding").alias("x"))
    return sg.gram_packs(x, ["label"])


@query()
def low_rank_report(s, d):
    return sg.low_rank_report(gram_packs(s, d), ["label"], 0.5).drop("kept", "total")


@query(f"with {_X} select label, 64::bigint nc, count(distinct vec_id) ns, round(sum(v * v), 6) total, round(sum(v * v), 6) kept_and_rest from x group by 1")
def low_rank_energy(s, d):
    """What the eigenvalues hold together is the samples' energy, and what is kept and the error of the rest add up to it."""
    x = sg.low_rank_report(gram_packs(s, d), ["label"], 0.5)
    return x.select("label", "nc", "ns", F.round("total", 6).alias("total"), F.round(F.col("kept") + F.col("rmse") ** 2 * F.col("ns") * F.col("nc"), 6).alias("kept_and_rest"))


@query(f"with {_X}, c as (select * from x) select a.label, a.pos a, b.pos b, round(sum(a.v * b.v), 6) g, count(*) n from c a join c b on a.vec_id = b.vec_id and a.pos <= b.pos group by 1, 2, 3")
def channel_gram(s, d):
    return sg.channel_gram(gram_packs(s, d), ["label"]).withColumn("g", F.round("g", 6))


def snippets(s, d):
    """Vectors of a label as channels of a snippet, their places as its samples, re-referenced."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    x = t(s, d, "embeddings").withColumn("ch", place).select("label", "ch", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    half = F.size("x") / 2
    # sorted once a row, not once a channel as inside of the subtraction
    less = lambda s: F.transform("x", lambda v: v - (F.get(s, F.ceil(half).cast("int") - 1) + F.get(s, F.floor(half).cast("int"))) / 2)
    whole = x.groupBy("label", F.col("i").cast("long").alias("i")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ch", "v"))), lambda p: p["v"]).alias("x"))
    return whole.select("label", "i", F.lit(64).cast("long").alias("n"), F.get(F.transform(F.array(F.array_sort("x")), less), F.lit(0)).alias("x"))


@query(f"""with ch as (select label, row_number() over (partition by label order by vec_id) - 1 channel, embedding from embeddings), y as (select label, channel, u.p i, embedding[u.p + 1]::double v from ch, (select unnest(range(64)) p) u),
x as (select label, channel, i, v - median(v) over (partition by label, i) v from y), sd as (select label, channel, median(abs(v)) / 0.6745 sd, sqrt(avg(v * v)) rms from x group by 1, 2),
l as (select *, lag(v) over w p, lead(v) over w n from x join sd using (label, channel) window w as (partition by label, channel order by i)), c as (select label, channel, i, v from l where v < -1.5 * sd and v <= coalesce(p, v) and v < coalesce(n, 'infinity'::double)),
ev as (select * from c where not exists (select 1 from c o where o.label = c.label and abs(o.channel - c.channel) <= 2 and abs(o.i - c.i) <= 3 and (o.v < c.v or o.v = c.v and (o.channel < c.channel or o.channel = c.channel and o.i < c.i)))),
k as (select label, channel, count(*) n, avg(v) depth from ev group by 1, 2), wv as (select ev.label, ev.channel, x.i - ev.i o, avg(x.v) v from ev join x on x.label = ev.label and x.channel = ev.channel and x.i between ev.i - 3 and ev.i + 6 where ev.i >= 3 and ev.i <= 57 group by 1, 2, 3),
ws as (select label, channel, max(v) - min(v) ptp, arg_max(v, (abs(v), -o)) peak from wv group by 1, 2)
select label, channel::integer channel, round(rms, 6) rms, coalesce(k.n, 0) n_spikes, round(depth, 6) spike_depth, round(peak, 6) peak_val, round(ptp, 6) ptp from sd left join k using (label, channel) left join ws using (label, channel)""")
def bundle_columns(s, d):
    """The columns of the bundle that SQL can say."""
    x = feature_bundle(s, d)
    return x.select("label", "channel", "n_spikes", *(F.round(c, 6).alias(c) for c in ("rms", "spike_depth", "peak_val", "ptp")))


@query()
def feature_bundle(s, d):
    """RMS and band powers, power of the current-source density, largest correlation with a neighbour, and number, depth and
    mean waveform of spikes, one row per channel, from stored groups of columns."""
    keys, x = ["label"], snippets(s, d)
    path = folder(s, "bundle")
    writers.table(x, f"{path}/clean")
    groups = {
        "lf": lambda r: ft.lf(r, keys, 250.0, 32), "csd": lambda r: ft.csd(r, keys, 2, 0.02), "ap": lambda r: ft.ap(r, keys, 2),
        "wav": lambda r: ft.spiking(r, keys, 1.5, 2, 3, -3, 6),
    }
    return ft.bundle(s.read.parquet(f"{path}/clean"), keys, f"{path}/features", groups)[0]


@query(f"""with {_X}, p as (select label, vec_id, pos, v, abs(v - lag(v) over (partition by label, pos order by vec_id)) j, lag(vec_id) over (partition by label, pos order by vec_id) k from x),
f as (select label, vec_id, count(*) filter (abs(v) >= 0.25 or (k = vec_id - 1 and j >= 0.3)) / count(*) > 0.1 sat from p group by 1, 2),
g as (select label, vec_id, vec_id - row_number() over (partition by label order by vec_id) g from f where sat), sp as (select label, min(vec_id) a, max(vec_id) + 1 b from g group by label, g.g),
sz as (select label, count(*) n from f group by 1) select label, count(a) n_intervals, round(coalesce(sum(b - a), 0) / 250.0, 6) as seconds, round(coalesce(sum(b - a), 0) / n, 9) fraction, n % 2 = 0 muted from sz left join sp using (label) group by label, n""")
def saturation_report(s, d):
    """Vectors are samples, positions channels, labels recordings."""
    flags = sp.saturation(long_vectors(s, d), ["label"], "pos", "vec_id", "v", 0.25, 0.3, 0.1)
    spans = sg.islands(flags, ["label"], "vec_id", F.col("saturated"))
    x = sp.saturation_report(spans, flags.groupBy("label").agg(F.count("*").alias("n")), ["label"], 250.0, F.col("n") % 2 == 0)
    return x.withColumns({"seconds": F.round("seconds", 6), "fraction": F.round("fraction", 9)})


@query(f"""with {_X}, r as (select a.label, a.pos, b.pos q, case when stddev_pop(a.v) > 0 and stddev_pop(b.v) > 0 then corr(a.v, b.v) end r from x a join x b on a.vec_id = b.vec_id and a.pos <> b.pos and abs(a.pos - b.pos) <= 2 group by 1, 2, 3)
select label, pos channel, round(max(r), 6) correlation from r group by 1, 2""")
def neighbour_correlation(s, d):
    """G23."""
    return sp.neighbour_correlation(long_vectors(s, d), ["label"], "pos", "vec_id", "v", 2).withColumn("correlation", F.round("correlation", 6))


@query(f"""with {_X}, y as (select label, vec_id // 10 ch, (vec_id % 10) * 64 + pos i, v, vec_id from x), sd as (select vec_id, median(abs(v)) / 0.6745 sd from y group by 1),
l as (select *, lag(v) over w p, lead(v) over w n from y join sd using (vec_id) window w as (partition by vec_id order by i)), c as (select label, ch, i, v from l where v < -1.5 * sd and v <= coalesce(p, v) and v < coalesce(n, 'infinity'::double))
select label, ch, i, round(v, 6) v from c where not exists (select 1 from c o where o.label = c.label and abs(o.ch - c.ch) <= 1 and abs(o.i - c.i) <= 6 and (o.v < c.v or o.v = c.v and (o.ch < c.ch or o.ch = c.ch and o.i < c.i)))""")
def separate_spikes(s, d):
    """Minima over neighbouring channels with a dead time.  Ten vectors in a row are one channel."""
    x = long_vectors(s, d).select("label", F.floor(F.col("vec_id") / 10).alias("ch"), ((F.col("vec_id") % 10) * 64 + F.col("pos")).alias("i"), "v", "vec_id")
    found = sg.detect_spikes(x, ["vec_id"], "i", "v", 1.5)
    return sp.separate(found, ["label"], "ch", "i", "v", 1, 6).select("label", "ch", "i", F.round("v", 6).alias("v"))


@query(f"""with {E}, h as (select event_type, floor(tm / 3600)::bigint i, sum(value) v from e group by 1, 2), b as (select event_type, min(i) a, max(i) z from h group by 1),
g as (select event_type, i, coalesce(v, 0) v from (select event_type, unnest(range(a, z + 1)) i from b) left join h using (event_type, i)),
k as (select user_id, event_type, event_id, floor(tm / 3600)::bigint a from e qualify row_number() over (partition by user_id order by (event_id * 7919) % 10007, event_id) <= 256),
c as (select user_id, event_id, i - a + 42 sample, g.v from k join g on g.event_type = k.event_type and i between a - 42 and a + 85), f as (select event_id from c group by 1 having count(*) = 128)
select user_id, sample::integer sample, round(avg(v), 9) v, count(*) n from c join f using (event_id) group by 1, 2""")
def unit_waveforms(s, d):
    """Up to 256 events a unit, 128 samples with the event at sample 42, and their mean."""
    e = t(s, d, "events")
    # a task's units are as many with more events, as each leaves 128 sums
    e = tables.spread(spikes(s, d).select("user_id", "event_id", "event_type", F.floor(F.col("tm") / HOUR).alias("at")), ["user_id"], e.count())
    some = ev.capped_events(e, ["user_id"], "event_id", 256, draw=draw())
    cut = sp.cutouts(some, hourly_by_type(s, d), ["event_type"], ["user_id", "event_id"], "at", -42, 85, few=1 << 16)
    return sp.mean_waveforms(cut, ["user_id"]).withColumn("v", F.round("v", 9))
