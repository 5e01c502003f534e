"""Encoding models.  A recording is a supplier, its samples are its line items in order; quantity, discount and tax are the
base regressors, price (in thousands) the target."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from recloom.operators import behaviour as bh
from recloom.operators import decoding as de
from recloom.operators import encoding as en
from recloom.operators import events as ev
from recloom.operators import tables
from recloom.plans.base import query, t
from recloom.plans.events import HOUR, spikes
from recloom.sources import runs, writers
from recloom.sources.scratch import folder

GROUPS = ["move", "stim", "stim"]
FOLDS = 5
#: Draws of a null.
DRAWS = 30
_R = """r as (select l_suppkey pid, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax) - 1 i, count(*) over (partition by l_suppkey) n,
l_quantity::double q, l_discount::double d, l_tax::double x, l_extendedprice / 1000.0::double y from lineitem)"""


#: What orders the samples of a recording.
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]


def rows(s, d):
    """One row per sample: a window per recording, which is as long as a recording.  Items of an order can have one number, so
    their other columns order them.  The key has its name before the window and arrays are made after it, so that they are not
    shuffled and sorted with the columns that they are made of, and what groups by the key needs no other shuffle."""
    own = Window.partitionBy("pid")
    x = t(s, d, "lineitem").select(F.col("l_suppkey").alias("pid"), *ORDER)
    x = x.withColumns({"i": F.row_number().over(own.orderBy(*ORDER)), "n": F.count("*").over(own)})
    return x.select(
        "pid", (F.col("i") - 1).cast("long").alias("i"), "n",
        F.array(F.col("l_quantity").cast("double"), F.col("l_discount").cast("double"), F.col("l_tax").cast("double")).alias("x"), F.array(F.col("l_extendedprice") / 1000.0).alias("y"),
    )


def long_rows(s, d):
    return rows(s, d).select("pid", "i", "n", F.col("x")[0].alias("q"), F.col("x")[1].alias("d"), F.col("x")[2].alias("x"), F.col("y")[0].alias("y"))


def lagged_statistics(s, d, keys=("pid",), data=None):
    b = en.basis_matrix(en.basis_table(s, 1.0, 1.0, 2.0, 3))
    return en.chunk_packs(rows(s, d) if data is None else data, list(keys), b, 1, FOLDS)


def lagged_fit(s, x, fit, keys=("pid",), n_targets=1, draws=None):
    b = en.basis_matrix(en.basis_table(s, 1.0, 1.0, 2.0, 3))
    return en.fit_rows(x, list(keys), b, 1, FOLDS, n_targets, fit, draws)


def with_own(draws):
    """Draws of recordings, and -1, which leaves a recording as it is."""
    return draws.unionByName(draws.select("pid", "n").distinct().select("*", F.lit(-1).alias("perm"), F.lit(0).cast("long").alias("shift")))


def stored(s, x, label):
    path = folder(s, label)
    writers.table(x, path)
    return s.read.schema(x.schema).parquet(path)


def lagged_null(s, x, n_targets, lambdas, draws, label):
    """The scores of recordings and those of their draws, from one pass over the samples, stored."""
    scores = stored(s, lagged_fit(s, x, en.scoring(GROUPS, 3, n_targets, lambdas, drop=False), ("pid",), n_targets, with_own(draws)), label)
    return scores.filter("perm < 0").drop("perm"), scores.filter("perm >= 0")


_B = """b as (select j, (j - 3) / 2.0::double tau, k, case when abs((j - k * 3.0) / 3.0) <= 1 then 0.5 * (1 + cos(pi() * (j - k * 3.0) / 3.0)) else 0 end v from (select unnest(range(10)) j), (select unnest(range(4))::integer k))"""


@query(f"""with {_B}, i as (select user_id, floor((epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id)) / 3.6e9)::bigint j from events),
c as (select user_id, j, count(*) n from i where j between 0 and 9 group by 1, 2) select user_id, k, round(sum(n * v), 6) weight from c join b using (j) where v <> 0 group by 1, 2""")
def basis_table(s, d):
    """How much of a user's gaps between events, in hours, lies under each bump."""
    gaps = ev.intervals(spikes(s, d), ["user_id"], "tm", "event_id").groupBy("user_id", F.floor(F.col("isi") / HOUR).alias("j")).agg(F.count("*").alias("n"))
    b = en.basis_table(s, 2.0, 1.5, 3.0, 4).filter("v != 0")
    return gaps.join(F.broadcast(b), "j").groupBy("user_id", "k").agg(F.round(F.sum(F.col("n") * F.col("v")), 6).alias("weight"))


_D = "dt as (select o_orderdate::date dd, sum(o_totalprice) v from orders group by 1), db as (select row_number() over (order by dd) - 1 i, count(*) over () n, v / 100000 v from dt)"


def daily(s, d):
    """Daily totals in order.  The window without a key is over days, of which there are a few thousand."""
    x = t(s, d, "orders").groupBy(F.to_date("o_orderdate").alias("dd")).agg(F.sum("o_totalprice").alias("v"))
    return x.select((F.row_number().over(Window.orderBy("dd")) - 1).cast("long").alias("i"), F.count("*").over(Window.partitionBy()).alias("n"), (F.col("v") / 100000).alias("v"))


@query(f"with {_D}, {_B} select k, db.i + j - 3 i, round(sum(db.v * b.v), 9) x from db, b where b.v <> 0 and db.i + j - 3 >= 0 and db.i + j - 3 < n group by 1, 2")
def lag_expand(s, d):
    base = daily(s, d).withColumn("r", F.lit(0))
    return en.lag_expand(base, en.basis_table(s, 2.0, 1.5, 3.0, 4), [], 3, "n").select("k", "i", F.round("x", 9).alias("x"))


@query(f"with {_D} select (i + 17) % n i, round(v, 7) v from db")
def circular_shift(s, d):
    return en.circular_shift(daily(s, d), "i", "n", F.lit(17)).select("i", F.round("v", 7).alias("v"))


@query(f"with {_D}, f as (select i, n, floor(((i + 1) * 5 - 1) / n)::integer fold from db) select i, fold, floor((i - floor(n * fold / 5)) / 30)::integer chunk from f")
def chunk_label(s, d):
    x = daily(s, d).withColumn("fold", en.fold_label(F.col("i"), F.col("n"), 5))
    return x.select("i", "fold", en.chunk_label(F.col("i"), F.floor(F.col("n") * F.col("fold") / 5), 30).alias("chunk"))


_GR = f"""{_R}, g as (select pid, (((i + 1) * 5 - 1) // n)::integer fold, count(*) n_rows, sum(q) sq, sum(y) sy, sum(y * y) syy, sum(q * q) qq, sum(q * d) qd, sum(q * y) qy, sum(d * y) dy from r group by 1, 2)"""


def grams(s, d):
    x = long_rows(s, d).withColumn("fold", en.fold_label(F.col("i"), F.col("n"), 5))
    p = lambda a, b: F.sum(F.col(a) * F.col(b))
    return x.groupBy("pid", "fold").agg(F.count("*").alias("n_rows"), F.sum("q").alias("sq"), F.sum("y").alias("sy"), p("y", "y").alias("syy"), p("q", "q").alias("qq"), p("q", "d").alias("qd"), p("q", "y").alias("qy"), p("d", "y").alias("dy"))


@query(f"with {_GR} select pid, fold, n_rows, round(sq, 4) sq, round(sy, 5) sy, round(syy, 3) syy, round(qq, 4) qq, round(qd, 4) qd, round(qy, 5) qy, round(dy, 7) dy from g")
def gram_by_fold(s, d):
    return grams(s, d).select("pid", "fold", "n_rows", *(F.round(c, k).alias(c) for c, k in {"sq": 4, "sy": 5, "syy": 3, "qq": 4, "qd": 4, "qy": 5, "dy": 7}.items()))


@query(f"with {_GR} select pid, fold, round(sum(qy) over (partition by pid) - qy, 5) rest from g")
def leave_one_out_gram(s, d):
    x = grams(s, d).select("pid", "fold", F.lit(0).alias("at"), F.col("qy").alias("v"))
    return en.leave_one_out(x, ["pid"]).select("pid", "fold", F.round("rest", 5).alias("rest"))


@query(f"with {_GR} select pid, round(sum(qq) - sum(sq) * sum(sq) / sum(n_rows), 3) sqq, round(sum(qy) - sum(sq) * sum(sy) / sum(n_rows), 3) sqy from g group by 1")
def centred_gram(s, d):
    x = grams(s, d).groupBy("pid").agg(*(F.sum(c).alias(c) for c in ("n_rows", "sq", "sy", "qq", "qy")))
    return x.select("pid", F.round(F.col("qq") - F.col("sq") * F.col("sq") / F.col("n_rows"), 3).alias("sqq"), F.round(F.col("qy") - F.col("sq") * F.col("sy") / F.col("n_rows"), 3).alias("sqy"))


@query(f"""with {_R}, u as (select pid, unnest(['q', 'd', 'x']) name, unnest(['move', 'stim', 'stim']) grp, unnest([q, d, x]) v from r) select pid, name, grp, round(avg(v), 6) mean, round(stddev_pop(v), 6) sd from u group by 1, 2, 3""")
def base_regressors(s, d):
    x = long_rows(s, d).unpivot(["pid"], ["q", "d", "x"], "name", "v")
    return x.groupBy("pid", "name", tables.map_lookup(F.col("name"), {"q": "move", "d": "stim", "x": "stim"}).alias("grp")).agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("sd"))


@query("""with h as (select user_id, event_type nm, case when event_type in ('purchase', 'signup') then 'buy' else 'look' end grp, row_number() over (partition by user_id order by event_type) - 1 r from (select distinct user_id, event_type from events)),
c as (select user_id, r, k, nm || '@b' || k::varchar name, grp, r * 4 + k col from h, (select unnest(range(4))::integer k)) select user_id, r, k, name, grp, col, min(col) over (partition by user_id, grp) as "first", max(col) over (partition by user_id, grp) as "last" from c""")
def design_columns(s, d):
    """The columns of designs whose regressors are the event types that a user has."""
    kinds = t(s, d, "events").select("user_id", F.col("event_type").alias("name")).distinct()
    r = F.row_number().over(Window.partitionBy("user_id").orderBy("name")) - 1
    grp = F.when(F.col("name").isin("purchase", "signup"), "buy").otherwise("look")
    return bh.design_columns(kinds.select("user_id", "name", r.cast("long").alias("r"), grp.alias("grp")), 4, ["user_id"])


@query("""with w as (select vec_id, u.k // 4 part, (u.k % 4)::integer k, embedding[u.k + 1]::double w from embeddings, (select unnest(range(64)) k) u), """ + _B + """ select vec_id, part, j, round(sum(v * w), 6) kernel from w join b using (k) group by 1, 2, 3""")
def kernel_expand(s, d):
    """Four values in a row are the weights of one target."""
    w = t(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "w"))
    w = w.select("vec_id", F.lit(0).alias("r"), F.floor(F.col("p") / 4).alias("target"), (F.col("p") % 4).alias("k"), F.col("w").cast("double").alias("w"))
    return en.kernels(w, en.basis_table(s, 2.0, 1.5, 3.0, 4), ["vec_id"]).select("vec_id", F.col("target").alias("part"), "j", F.round("kernel", 6).alias("kernel"))


def _one(table: str, keys: str, lam, p: str = "", places: int = 6) -> str:
    """Closed form of a ridge on one regressor: weight, R2 on all samples, mean R2 over held-out folds.  ``lam``: a number or a
    column among the keys; ``p``: before the names of the tables."""
    fit = lambda a: f"({a}qy - {a}sq * {a}sy / {a}n) / ({a}qq - {a}sq * {a}sq / {a}n + {lam})"
    scored = lambda w, c: f"1 - (syy - 2 * {w} * qy - 2 * {c} * sy + {w} * {w} * qq + 2 * {w} * {c} * sq + n * {c} * {c}) / (syy - sy * sy / n)"
    sums = "count(*)::double n, sum(q) sq, sum(y) sy, sum(y * y) syy, sum(q * q) qq, sum(q * y) qy"
    rest = ", ".join(f"sum({c}) over (partition by {keys}) - {c} r{c}" for c in ("n", "sq", "sy", "qq", "qy"))
    return f"""{p}f1 as (select {keys}, (((i + 1) * 5 - 1) // n)::integer fold, {sums} from {table} group by {keys}, fold), {p}f2 as (select *, {rest} from {p}f1),
{p}f3 as (select *, {fit("r")} w from {p}f2), {p}f4 as (select *, (rsy - w * rsq) / rn c from {p}f3), {p}f5 as (select {keys}, count(*) folds, min(syy - sy * sy / n) least, avg({scored("w", "c")}) r2_cv from {p}f4 group by {keys}),
{p}a1 as (select {keys}, sum(n) n, sum(sq) sq, sum(sy) sy, sum(syy) syy, sum(qq) qq, sum(qy) qy from {p}f1 group by {keys}), {p}a2 as (select *, {fit("")} w from {p}a1), {p}a3 as (select *, (sy - w * sq) / n c from {p}a2)
select {keys}, round(w, 7) w, round({scored("w", "c")}, {places}) r2_full, round(case when folds > 1 and least > 1e-6 then r2_cv end, {places}) r2_cv from {p}a3 join {p}f5 using ({keys})"""


def one_regressor(x):
    return x.withColumn("x", F.slice("x", 1, 1))


def _one_fit(packs, keys):
    w = en.weights(packs, keys, ["q"], 1, 1, 10.0).select(*keys, F.round("w", 7).alias("w"))
    fit = en.solve(packs, keys, ["q"], 1, 1, [10.0], drop=False)
    return w.join(fit.select(*keys, F.round("r2_full", 6).alias("r2_full"), F.round("r2_cv", 6).alias("r2_cv")), keys)


@query(f"with {_R}, {_one('r', 'pid', 10.0)}")
def ridge_one(s, d):
    """Statistics per fold, weight and scores of one regressor without lags."""
    return _one_fit(en.chunk_packs(one_regressor(rows(s, d)), ["pid"], np.eye(1), 0, FOLDS), ["pid"])


@query(f"""with {_R}, sh as (select pid, p.perm::integer perm, ((p.perm * 7 + 5) % any_value(n))::bigint k from r, (select unnest(range(3)) perm) p group by pid, p.perm),
z as (select t.pid, sh.perm, t.i, t.n, b.q, t.y from r t join sh using (pid) join r b on b.pid = t.pid and b.i = (t.i - sh.k + t.n) % t.n), {_one('z', 'pid, perm', 10.0)}""")
def null_one(s, d):
    """The same, with the regressor rolled by 5, 12 and 19 samples."""
    x = one_regressor(rows(s, d))
    draws = x.groupBy("pid").agg(F.first("n").alias("n")).withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(2))))
    draws = draws.withColumn("shift", F.pmod((F.col("perm") * 7 + 5).cast("long"), F.col("n")))
    return _one_fit(en.null_packs(x, ["pid"], draws, np.eye(1), 0, FOLDS), ["pid", "perm"])


@query(f"""with {_R}, rl as (select r.*, l.lam from r cross join (select unnest([1.0::double, 1000.0::double]) lam) l), {_one('rl', 'pid, lam', 'lam', 'o', 13)[:_one('rl', 'pid, lam', 'lam', 'o', 13).rindex('select')].rstrip()}, og as ({_one('rl', 'pid, lam', 'lam', 'o', 13)[_one('rl', 'pid, lam', 'lam', 'o', 13).rindex('select pid'):]}),
sh as (select pid, p.perm::integer perm, ((p.perm * 7 + 5) % any_value(n))::bigint k from r, (select unnest(range(3)) perm) p group by pid, p.perm),
z as (select t.pid, sh.perm, l.lam, t.i, t.n, b.q, t.y from r t join sh using (pid) join r b on b.pid = t.pid and b.i = (t.i - sh.k + t.n) % t.n cross join (select unnest([1.0::double, 1000.0::double]) lam) l),
{_one('z', 'pid, perm, lam', 'lam', 'n', 13)[:_one('z', 'pid, perm, lam', 'lam', 'n', 13).rindex('select')].rstrip()}, ng as ({_one('z', 'pid, perm, lam', 'lam', 'n', 13)[_one('z', 'pid, perm, lam', 'lam', 'n', 13).rindex('select pid'):]}),
bs as (select pid, lam, r2_full, r2_cv, coalesce(max(case when r2_cv >= -0.3 then greatest(-1, least(1, r2_cv)) end) over (partition by pid) = greatest(-1, least(1, r2_cv)) and r2_cv >= -0.3, false) top, bool_or(coalesce(r2_cv >= -0.3, false)) over (partition by pid) fine from og),
ch as (select * from bs where top or not fine qualify row_number() over (partition by pid order by case when fine then lam else -lam end) = 1),
pv as (select ch.pid, (1 + count(*) filter (ng.r2_cv >= ch.r2_cv)) / (count(*) + 1) p_value, quantile_cont(ng.r2_cv, 0.95) null_p95 from ch join ng on ng.pid = ch.pid and ng.lam = ch.lam group by 1)
select ch.pid, m.mode, lam, not fine fell_back, round(r2_full, 6) r2_full, round(r2_cv, 6) r2_cv, round(p_value, 9) p_value, round(null_p95, 6) null_p95, case when ch.pid % 2 = 0 then 'raw' else 'delta' end band, s_name acronym, s_nationkey channel
from ch join pv using (pid) left join supplier on s_suppkey = ch.pid cross join (select unnest(['pooled', 'per_target']) mode) m""")
def scored_one(s, d):
    """Score rows with penalty, p-value and what is known of the target, of one regressor; published and read back."""
    keys = ["pid"]
    x = stored(s, en.laid(one_regressor(rows(s, d)), keys), "scored_rows")
    grid = [1.0, 1000.0]
    # -1 leaves a recording as it is
    draws = F.transform(F.sequence(F.lit(-1), F.lit(2)), lambda p: F.struct(p.alias("perm"), F.when(p < 0, 0).otherwise(F.pmod((p * 7 + 5).cast("long"), F.col("n"))).alias("shift")))
    # stored, as penalties, scores and p-values each read them
    fit = stored(s, en.fit_rows(x, keys, np.eye(1), 0, FOLDS, 1, en.scoring(["q"], 1, 1, grid), draws), "scored_fits")
    table, null = en.score_table(fit.filter("perm < 0").drop("perm"), keys, ["q"]), fit.filter("perm >= 0")
    meta = t(s, d, "supplier").select(F.col("s_suppkey").alias("pid"), F.lit(0).alias("target"), F.when(F.col("s_suppkey") % 2 == 0, "raw").otherwise("delta").alias("band"), F.col("s_name").alias("acronym"), F.col("s_nationkey").alias("channel"))
    path = folder(s, "scored_one")
    runs.publish(path, {"scores": en.described(en.with_null(table, null, keys), meta, keys), "weights": en.fit_rows(x, keys, np.eye(1), 0, FOLDS, 1, en.weighing(["q"], 1, 1, 10.0))}, keys)
    got = runs.read(s, path, "scores", keys)
    places = {"r2_full": 6, "r2_cv": 6, "p_value": 9, "null_p95": 6}
    return got.select("pid", "mode", "lam", "fell_back", *(F.round(c, k).alias(c) for c, k in places.items()), "band", "acronym", "channel")


@query()
def ridge_fit(s, d):
    return en.weights(lagged_statistics(s, d), ["pid"], GROUPS, 3, 1, 10.0)


@query()
def cv_r2(s, d):
    return en.solve(lagged_statistics(s, d), ["pid"], GROUPS, 3, 1, [1.0, 100.0], drop=False)


@query()
def drop_r2(s, d):
    return en.drop_scores(en.solve(lagged_statistics(s, d), ["pid"], GROUPS, 3, 1, [10.0]), ["pid"])


@query()
def null_r2(s, d):
    """Recordings x draws in one job; the observed score and the null share statistics code and grid."""
    x = stored(s, rows(s, d), "null_rows")
    draws = en.shift_draws(x.groupBy("pid").agg(F.first("n").alias("n")), ["pid"], DRAWS, 20)
    seen, null = lagged_null(s, x, 1, [10.0], draws, "null_r2")
    return en.p_value(null.select("pid", F.col("r2_cv").alias("r2")), seen.select("pid", F.col("r2_cv").alias("r2")), ["pid"])


_T = "f as (select l_suppkey target, l_returnflag grp, l_linenumber::double lam, round(avg(l_discount) * 40 - 2 + sum(l_tax) * 0.001, 6) r2 from lineitem group by 1, 2, 3)"


def r2_table(s, d):
    return t(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("target"), F.col("l_returnflag").alias("grp"), F.col("l_linenumber").cast("double").alias("lam")).agg(F.round(F.avg("l_discount") * 40 - 2 + F.sum("l_tax") * 0.001, 6).alias("r2"))


@query(f"with {_T}, m as (select grp, lam, median(r2) objective from f group by 1, 2) select grp, lam, round(objective, 6) objective from m qualify row_number() over (partition by grp order by objective desc, lam) = 1")
def lambda_pick(s, d):
    return en.pick_lambda(r2_table(s, d), ["grp"]).withColumn("objective", F.round("objective", 6))


@query(f"""with {_T}, m as (select grp, lam, avg(greatest(-1, least(1, r2))) objective, quantile_cont(r2, 0.05) low from f group by 1, 2), b as (select grp, lam from m where low >= case when grp = 'N' then 9 else -0.9 end qualify row_number() over (partition by grp order by objective desc, lam) = 1)
select grp, coalesce(b.lam, mx) lam, b.lam is null fell_back from (select grp, max(lam) mx from m group by 1) left join b using (grp)""")
def lambda_pick_robust(s, d):
    x = r2_table(s, d)
    return en.pick_lambda_robust(x.filter("grp != 'N'"), ["grp"], floor=-0.9).unionByName(en.pick_lambda_robust(x.filter("grp = 'N'"), ["grp"], floor=9.0))


@query(f"with {_T} select target, grp, lam, r2 from f qualify row_number() over (partition by target, grp order by r2 desc, lam) = 1")
def argmax_first(s, d):
    return en.first_best(r2_table(s, d), ["target", "grp"], "r2", "lam").select("target", "grp", "lam", "r2")


@query(f"with {_T}, b as (select target, grp, min(lam) lam from f where r2 > 0.5 group by 1, 2) select target, grp, coalesce(b.lam, mx) lam, b.lam is null fell_back from (select target, grp, max(lam) mx from f group by 1, 2) left join b using (target, grp)")
def fallback_largest(s, d):
    x, keys = r2_table(s, d), ["target", "grp"]
    return en.fallback_largest(x, x.filter("r2 > 0.5").groupBy(*keys).agg(F.min("lam").alias("_lam")), keys, "lam")


@query(f"with {_T}, o as (select target, r2 obs from f where grp = 'A' and lam = 1), u as (select f.target, obs, r2 from f join o using (target) where grp <> 'A') select target, round((1 + count(*) filter (r2 >= obs)) / (count(*) + 1), 9) p_value, round(quantile_cont(r2, 0.95), 8) null_p95 from u group by 1")
def null_pvalue(s, d):
    x = r2_table(s, d)
    p = en.p_value(x.filter("grp != 'A'").select("target", "r2"), x.filter("grp = 'A' and lam = 1").select("target", "r2"), ["target"])
    return p.select("target", F.round("p_value", 9).alias("p_value"), F.round("null_p95", 8).alias("null_p95"))


@query(f"""with {_T}, o as (select target, grp, lam asked, r2 r2_cv from f) select target, grp, asked, s_name acronym, case when target % 2 = 0 then 'raw' else 'delta' end band, case when target % 2 = 0 then 10.0 else 1.0 end::double lam, r2_cv, target % 3 = 0 has_wheel from o join supplier on target = s_suppkey""")
def score_rows(s, d):
    o = r2_table(s, d).select("target", "grp", F.col("lam").alias("asked"), F.col("r2").alias("r2_cv"))
    meta = t(s, d, "supplier").select(F.col("s_suppkey").alias("target"), F.col("s_name").alias("acronym"))
    x = o.join(meta, "target").withColumn("band", F.when(F.col("target") % 2 == 0, "raw").otherwise("delta"))
    return x.select("target", "grp", "asked", "acronym", "band", tables.map_lookup(F.col("band"), {"raw": 10.0, "delta": 1.0}).alias("lam"), "r2_cv", (F.col("target") % 3 == 0).alias("has_wheel"))


@query()
def fit_all(s, d):
    """Every recording, the penalty picked per recording, with a status row where the fit is impossible."""
    path = folder(s, "fit_all")
    scores = en.solve(lagged_statistics(s, d), ["pid"], GROUPS, 3, 1, [1.0, 10.0, 100.0, 1000.0])
    writers.table(scores, path)
    scores = s.read.schema(scores.schema).parquet(path)
    best = en.pick_lambda_robust(scores.filter("dropped = ''").select("pid", "lam", F.col("r2_cv").alias("r2")), ["pid"])
    return scores.join(best, ["pid", "lam"])


@query()
def fit_all_sources(s, d):
    """Three tiers of one signal (whole, rounded, coarse) on the same rows, in one pass keyed by tier."""
    x = rows(s, d)
    tiers = [("full", F.col("y")), ("rounded", F.transform("y", lambda v: F.round(v, 0))), ("coarse", F.transform("y", lambda v: F.floor(v / 10).cast("double")))]
    all_rows = x.withColumn("tier", F.explode(F.array(*[F.lit(k) for k, _ in tiers])))
    y = tiers[0][1]
    for k, c in tiers[1:]:
        y = F.when(F.col("tier") == k, c).otherwise(y)
    scores = lagged_fit(s, all_rows.withColumn("y", y), en.scoring(GROUPS, 3, 1, [10.0], drop=False), ("tier", "pid"))
    return tables.tier_differences(scores.select("tier", "pid", "target", "r2_cv"), "tier", ["pid", "target"], ["r2_cv"], "full")


#: Bins of counts around a trial, null series, and runs of a decoder.
BINS, NULLS, RUNS = 10, 30, 3


def decoding_rows(s, d):
    """Sessions are users, trials their clicks, units the other event types; a null series is another user's clicks."""
    e = spikes(s, d)
    clicks = e.filter("event_type = 'click'").withColumnRenamed("event_id", "trial")
    counts = ev.trial_counts(clicks, e.filter("event_type != 'click'"), ["user_id"], "trial", "tm", "event_type", "tm", -6 * HOUR, 1.2 * HOUR, BINS)
    x = de.features(counts, clicks, ["user_id"], "trial", BINS)
    return x.join(de.other_sessions(clicks, "user_id", "trial", "tm", "value", NULLS), ["user_id", "trial"])


@query()
def decode_cv(s, d):
    """The value of a click from ten bins of every unit's counts around it, over three runs, against thirty null series."""
    return de.against_null(de.decode(decoding_rows(s, d), ["user_id"], "trial", NULLS + 1, RUNS), ["user_id"])


@query()
def decode_two_class(s, d):
    """Whether a click's value is over 50, by a logistic model."""
    x = decoding_rows(s, d).withColumn("y", F.transform("y", lambda v: (v > 50).cast("double")))
    return de.against_null(de.decode_classes(x, ["user_id"], "trial", NULLS + 1, RUNS), ["user_id"])


@query("""with c as (select user_id, event_id trial, value, row_number() over (partition by user_id order by epoch_us(ts), event_id) - 1 j, count(*) over (partition by user_id) n from events where event_type = 'click'),
ss as (select user_id, any_value(n) n_of, row_number() over (order by user_id) - 1 r, count(*) over () n_all from c group by 1),
w as (select ss.user_id, k, (r + 1 + (k - 1) % (n_all - 1)) % n_all src from ss, (select unnest(range(1, 31)) k))
select c.user_id, c.trial, w.k::integer series, o.value v from c join w using (user_id) join ss on ss.r = w.src join c o on o.user_id = ss.user_id and o.j = c.j % ss.n_of
union all select user_id, trial, 0, value from c""")
def null_series(s, d):
    """The target of every trial and its null series, in long form."""
    clicks = spikes(s, d).filter("event_type = 'click'").withColumnRenamed("event_id", "trial")
    return de.other_sessions(clicks, "user_id", "trial", "tm", "value", NULLS).select("user_id", "trial", F.posexplode("y").alias("series", "v"))


@query()
def grouped_fit(s, d):
    """Two groups of targets (gross and net price), each with the penalty that suits it, from one table of
    statistics; with it a p-value against circular shifts scored at the same penalty."""
    x = stored(s, rows(s, d).withColumn("y", F.array(F.col("y")[0], F.col("y")[0] * (1 - F.col("x")[1]))), "grouped_rows")
    groups = s.createDataFrame([(0, "gross"), (1, "net")], "target int, grp string")
    grid = [1.0, 100.0, 10_000.0]
    draws = en.shift_draws(x.groupBy("pid").agg(F.first("n").alias("n")), ["pid"], DRAWS, 20)
    scores, null = lagged_null(s, x, 2, grid, draws, "grouped_fit")
    best = en.pick_lambda_robust(scores.join(F.broadcast(groups), "target").select("pid", "grp", "lam", F.col("r2_cv").alias("r2")), ["pid", "grp"])
    seen = en.per_group(scores, groups, best, ["pid"])
    null = en.per_group(null, groups, best, ["pid"])
    p = en.p_value(null.select("pid", "target", F.col("r2_cv").alias("r2")), seen.select("pid", "target", F.col("r2_cv").alias("r2")), ["pid", "target"])
    return seen.select("pid", "target", "grp", "lam", "r2_full", "r2_cv").join(p, ["pid", "target"])
