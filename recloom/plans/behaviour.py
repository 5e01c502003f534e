"""Trials, behaviour and designs.  A session is a user: clicks are trials, views the wheel, purchases the pupil, and the grid
has a sample every six hours."""

from __future__ import annotations

from pyspark.sql import functions as F

from recloom.operators import behaviour as bh
from recloom.operators import encoding as en
from recloom.operators import signal as sg
from recloom.plans.base import query, t
from recloom.plans.events import DAY, E, spikes
from recloom.sources import runs, writers
from recloom.sources.scratch import folder

#: Bumps of the fits' lag basis.  With two, the penalty is a plain ridge, so that sessions of few trials have a solution.
BUMPS = 2
#: Penalties that are tried.
LAMBDAS = [10.0, 100.0, 1000.0]
STEP = 6 * 3600.0
_T = f"""{E}, tr0 as (select user_id, event_id, tm stim, case when value < 95 then tm + value * 600 end mv, case when value < 98 then tm + value * 1800 end fb,
case when event_id % 2 = 0 then value / 100 end cr, case when event_id % 2 = 1 then value / 100 end cl, case when event_id % 3 = 0 then -1.0 when event_id % 3 = 1 then 1.0 end ch, case when event_id % 5 < 3 then 1.0 else -1.0 end ft from e where event_type = 'click'),
tr as (select *, coalesce(cr, 0) - coalesce(cl, 0) c, row_number() over (partition by user_id order by stim, event_id) - 1 trial from tr0)"""
_B = f"""{_T}, gr as (select user_id, unnest(range(floor(min(tm) / {STEP})::bigint, ceil(max(tm) / {STEP})::bigint + 1)) i from e where user_id in (select user_id from tr) group by 1),
ends as (select user_id, min(i) a, max(i) b from gr group by 1),
st as (select user_id, case event_type when 'view' then 'wheel' else 'pupil' end stream, tm t, case when event_type = 'view' or value < 60 then value end v from e where event_type in ('view', 'purchase') and user_id in (select user_id from tr)),
fl as (select user_id, stream, count(*) n, (count(v) / count(*)) >= 0.5 usable from st group by 1, 2),
us as (select user_id, stream from fl join (select user_id, stream, min(t) s0, max(t) s1 from st group by 1, 2) using (user_id, stream) join ends using (user_id)
  where usable and b > a and greatest(0, least(b * {STEP}, s1) - greatest(a * {STEP}, s0)) >= 0.8 * (b - a) * {STEP})"""


def clicks(s, d):
    e, k = spikes(s, d).filter("event_type = 'click'"), F.col("event_id")
    return e.select(
        "user_id", "event_id", F.col("tm").alias("stimOn_times"), F.when(F.col("value") < 95, F.col("tm") + F.col("value") * 600).alias("firstMovement_times"), F.when(F.col("value") < 98, F.col("tm") + F.col("value") * 1800).alias("feedback_times"),
        F.when(k % 2 == 0, F.col("value") / 100).alias("contrastRight"), F.when(k % 2 == 1, F.col("value") / 100).alias("contrastLeft"),
        F.when(k % 3 == 0, -1.0).when(k % 3 == 1, 1.0).alias("choice"), F.when(k % 5 < 3, 1.0).otherwise(-1.0).alias("feedbackType"),
    )


def sessions(s, d):
    return clicks(s, d).select("user_id").distinct()


def trial_table(s, d):
    return bh.trials(clicks(s, d), sessions(s, d), ["user_id"], "stimOn_times")


def traces(s, d):
    e = spikes(s, d).filter("event_type in ('view', 'purchase')").join(sessions(s, d), "user_id")
    wheel = F.col("event_type") == "view"
    # a value that is missing is NaN, as in an array of the same length as its times
    return e.select("user_id", F.when(wheel, "wheel").otherwise("pupil").alias("stream"), F.col("tm").alias("t"), F.when(wheel | (F.col("value") < 60), F.col("value")).otherwise(float("nan")).alias("v"))


def grid(s, d):
    ends = spikes(s, d).join(sessions(s, d), "user_id").groupBy("user_id").agg(F.floor(F.min("tm") / STEP).alias("a"), F.ceil(F.max("tm") / STEP).alias("b"))
    return ends.select("user_id", F.explode(F.sequence("a", "b")).alias("i")).withColumn("t", F.col("i") * STEP)


def used(s, d):
    x = traces(s, d)
    return bh.streams_in_use(bh.stream_flags(sessions(s, d), x, ["user_id"]), x, grid(s, d), ["user_id"])


def base(s, d):
    return bh.base_regressors(trial_table(s, d), traces(s, d), used(s, d), grid(s, d), ["user_id"], 0.0, STEP, DAY)


@query(f"with {_T} select user_id, trial, event_id, round(stim, 6) stim, round(c, 6) contrast from tr")
def session_trials(s, d):
    """S16, P7."""
    return trial_table(s, d).select("user_id", "trial", "event_id", F.round("stimOn_times", 6).alias("stim"), F.round("contrast", 6).alias("contrast"))


@query(f"with {_B}, w as (select distinct user_id, unnest(['wheel', 'pupil']) stream from tr) select user_id, stream, coalesce(n, 0) n, coalesce(usable, false) usable from w left join fl using (user_id, stream)")
def behaviour_flags(s, d):
    """S15, P9."""
    return bh.stream_flags(sessions(s, d), traces(s, d), ["user_id"])


_EV = f"""ev as (select user_id, least(greatest(ceil(t / {STEP}), a), b)::bigint i, name, sum(w) v from (select user_id, stim t, 1.0 w, 'stimOn_on' name from tr union all select user_id, stim, c, 'stimOn_contrast' from tr
union all select user_id, mv, 1.0, 'move_on' from tr union all select user_id, mv, ch, 'move_choice' from tr union all select user_id, fb, 1.0, 'feedback_on' from tr union all select user_id, fb, ft, 'feedback_type' from tr) join ends using (user_id)
where t is not null and w is not null group by 1, 2, 3)"""


@query(f"""with {_B}, {_EV}, nm as (select unnest(['stimOn_on', 'stimOn_contrast', 'move_on', 'move_choice', 'feedback_on', 'feedback_type']) name),
sm as (select user_id, stream, t, v from st join us using (user_id, stream) where v is not null), g2 as (select user_id, stream, i, i * {STEP} t from gr join us using (user_id)),
lo as (select g2.*, sm.t t0, sm.v v0 from g2 asof left join sm on g2.user_id = sm.user_id and g2.stream = sm.stream and g2.t >= sm.t),
hi as (select lo.*, sm.t t1, sm.v v1 from lo asof left join sm on lo.user_id = sm.user_id and lo.stream = sm.stream and lo.t <= sm.t),
rs as (select user_id, stream, i, case when t0 is null then v1 when t1 is null or t1 = t0 then v0 else v0 + (v1 - v0) * (t - t0) / (t1 - t0) end v from hi),
cn as (select user_id, i, 'pupil' name, v from rs where stream = 'pupil' union all select user_id, i, 'wheel_vel', v from rs where stream = 'wheel' union all select user_id, i, 'wheel_speed', abs(v) from rs where stream = 'wheel')
select user_id, name, gr.i, round(coalesce(v, 0), 5) v from gr cross join nm left join ev using (user_id, i, name)
union all select user_id, name, i, round(case when stddev_pop(v) over w > 0 then (v - avg(v) over w) / stddev_pop(v) over w else v - avg(v) over w end, 5) from cn window w as (partition by user_id, name)""")
def regressors_on_grid(s, d):
    """J9 six times, W6, W7 and A28's gate."""
    return base(s, d).withColumn("v", F.round("v", 5))


@query(f"""with {_B}, nm as (select unnest(range(9)) place, unnest(['stimOn_on', 'stimOn_contrast', 'move_on', 'move_choice', 'feedback_on', 'feedback_type', 'wheel_vel', 'wheel_speed', 'pupil']) nm,
unnest(['stimOn', 'stimOn', 'move', 'move', 'feedback', 'feedback', 'wheel', 'wheel', 'pupil']) grp), h as (select user_id, nm, grp, row_number() over (partition by user_id order by place) - 1 r from (select distinct user_id from tr), nm where place < 6 or (user_id, grp) in (select (user_id, stream) from us)),
c as (select user_id, r, k, nm || '@b' || k::varchar name, grp, r * 4 + k col from h, (select unnest(range(4))::integer k)) select user_id, r::integer r, k, name, grp, col, min(col) over (partition by user_id, grp) as "first", max(col) over (partition by user_id, grp) as "last" from c""")
def session_columns(s, d):
    """The columns of every session's own design."""
    return bh.design_columns(bh.regressor_table(used(s, d), sessions(s, d), ["user_id"]), 4, ["user_id"])


def design(s, d):
    """Targets: the sum of a session's sign-up values per sample (family raw) and its size in three classes (family band)."""
    g = grid(s, d)
    e = spikes(s, d).filter("event_type = 'signup'").withColumn("one", F.lit(1.0))
    raw = sg.event_to_grid(e, g, ["user_id"], "tm", "value", 0.0, STEP).select("user_id", "i", F.col("w").alias("y"))
    y = raw.select("user_id", "i", F.inline(F.array(
        F.struct(F.lit("raw").alias("kind"), F.array(F.col("y"), F.sqrt("y")).alias("y")),
        F.struct(F.lit("band").alias("kind"), F.array((F.col("y") > 0).cast("double"), (F.col("y") > 50).cast("double")).alias("y")),
    )))
    return bh.design_rows(base(s, d), y, ["user_id"])


def lagged_fit(s, rows, fit, draws=None):
    b = en.basis_matrix(en.basis_table(s, 1 / STEP, STEP, 2 * STEP, BUMPS))
    return en.fit_rows(rows, ["user_id", "kind"], b, 1, 5, 2, fit, draws)


#: Draws of a session's null, and the samples at either end to which no shift goes.
DRAWS, MARGIN = 30, 2


@query()
def session_fits(s, d):
    """Every session, both families of targets, one penalty for a whole family and one per target, as score rows with
    p-values and what is known of the targets; published together with the weights, and read back."""
    path, keys = folder(s, "session_fits"), ["user_id", "kind"]
    rows = design(s, d)
    writers.table(rows, f"{path}/design")
    rows = s.read.schema(rows.schema).parquet(f"{path}/design")
    scores = lagged_fit(s, rows, en.scoring(bh.groups_by_size(), BUMPS, 2, LAMBDAS))
    writers.table(scores, f"{path}/grid")
    scores = s.read.schema(scores.schema).parquet(f"{path}/grid")
    table = en.score_table(scores, keys, ["stimOn", "move", "feedback", "wheel", "pupil"])
    draws = en.shift_draws(rows.groupBy(*keys).agg(F.first("n").alias("n")), keys, DRAWS, MARGIN)
    null = lagged_fit(s, rows, en.scoring(bh.groups_by_size(), BUMPS, 2, LAMBDAS, drop=False), draws)
    band = F.when(F.col("kind") == "raw", "raw").when(F.col("target") == 0, "delta").otherwise("theta")
    c = t(s, d, "customer").join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    meta = table.select(*keys, "target").distinct().join(c.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("channel"), F.col("n_name").alias("acronym")), "user_id", "left").withColumn("band", band)
    runs.publish(f"{path}/run", {
        "scores": en.described(en.with_null(table, null, keys), meta, keys).withColumn("source", F.lit("full")),
        "weights": lagged_fit(s, rows, en.weighing(bh.groups_by_size(), BUMPS, 2, 1000.0)).withColumn("source", F.lit("full")),
    }, ["source", *keys])
    return runs.read(s, f"{path}/run", "scores", ["source", *keys]).drop("source")


@query()
def stored_run(s, d):
    """K8, K9: settings and basis written once, basis weights by (source, kind); read back, a weight is a kernel over lags."""
    path = folder(s, "stored_run")
    basis = en.basis_table(s, 1 / STEP, STEP, 2 * STEP, BUMPS)
    writers.run_settings(s, f"{path}/run", {"fs": 1 / STEP, "lambda": 1000.0, "n_basis": float(BUMPS), "n_folds": 5.0}, {"groups": bh.NAMES}, basis)
    w = lagged_fit(s, design(s, d), en.weighing(bh.groups_by_size(), BUMPS, 2, 1000.0))
    writers.by_key(w.withColumn("source", F.lit("full")), f"{path}/weights", ["source", "kind"])
    stored = s.read.parquet(f"{path}/weights")
    return en.kernels(stored, s.read.parquet(f"{path}/run/basis"), ["source", "kind", "user_id"])
