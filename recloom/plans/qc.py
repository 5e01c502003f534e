"""Quality reports.  Recordings are orders, chunks are line items, a chunk's label is its return flag."""

from __future__ import annotations

from pyspark.sql import functions as F

from recloom.operators import qc, tables
from recloom.plans.base import query, t

FLAGS = {"a": "A", "n": "N", "r": "R"}


def per_recording(s, d):
    """Chunk summary, label counts and order attributes, one row per recording."""
    li, o = t(s, d, "lineitem"), t(s, d, "orders")
    chunks = qc.chunk_summary(li, ["l_orderkey"], ["l_extendedprice", "l_discount"])
    labels = qc.label_counts(li, ["l_orderkey"], "l_returnflag", FLAGS, "N").drop("n")
    return o.join(chunks.join(labels, "l_orderkey"), o["o_orderkey"] == F.col("l_orderkey"), "left").drop("l_orderkey")


@query("""
select o_orderkey, o_orderpriority, n_chunks, round(price_mean, 6) price_mean, round(price_median, 6) price_median, price_max, round(disc_mean, 6) disc_mean,
  coalesce(n_a, 0) n_a, coalesce(n_n, 0) n_n, coalesce(n_r, 0) n_r, round(case when n_chunks <> 0 then (n_a + n_r) / n_chunks end, 6) frac_bad
from orders left join (select l_orderkey, count(*) n_chunks, avg(l_extendedprice) price_mean, median(l_extendedprice) price_median, max(l_extendedprice) price_max, avg(l_discount) disc_mean,
  count(*) filter (l_returnflag = 'A') n_a, count(*) filter (l_returnflag = 'N') n_n, count(*) filter (l_returnflag = 'R') n_r from lineitem group by 1) on o_orderkey = l_orderkey""")
def qc_per_recording(s, d):
    x = per_recording(s, d)
    return x.select(
        "o_orderkey", "o_orderpriority", "n_chunks", F.round("l_extendedprice_mean", 6).alias("price_mean"), F.round("l_extendedprice_median", 6).alias("price_median"), F.col("l_extendedprice_max").alias("price_max"),
        F.round("l_discount_mean", 6).alias("disc_mean"), *(F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in FLAGS), F.round(qc.ratio(F.col("n_bad"), F.col("n_chunks")), 6).alias("frac_bad"),
    )


@query("""
with rows as (select o_orderpriority, o_orderkey, l_linenumber, l_extendedprice, l_discount from orders join lineitem on o_orderkey = l_orderkey),
once as (select * from rows qualify row_number() over (partition by o_orderpriority, o_orderkey order by l_linenumber) = 1)
select * from (select o_orderpriority, count(*) n_rows, round(median(l_extendedprice), 4) price_median, max(l_extendedprice) price_max from rows group by 1)
join (select o_orderpriority, count(*) n_keys, round(median(l_discount), 6) discount_median, max(l_discount) discount_max from once group by 1) using (o_orderpriority)""")
def qc_pass_summary(s, d):
    li = t(s, d, "lineitem")
    n = li.count()
    # both sides by the same number of partitions, which the join and the window keep: a task sorts as many rows as before with more of them
    o = tables.spread(t(s, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey"], n)
    rows = o.join(tables.spread(li.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"), ["l_orderkey"], n), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderpriority", "o_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    x = qc.pass_summary(rows, "o_orderpriority", "o_orderkey", ["l_extendedprice"], ["l_discount"], ["l_linenumber"])
    return x.select("o_orderpriority", "n_rows", F.round("l_extendedprice_median", 4).alias("price_median"), F.col("l_extendedprice_max").alias("price_max"), "n_keys", F.round("l_discount_median", 6).alias("discount_median"), F.col("l_discount_max").alias("discount_max"))


@query("select o_orderstatus, count(*) n, max(abs(o_totalprice - 150000)) worst from orders group by 1")
def status_counts(s, d):
    return qc.status_counts(t(s, d, "orders").withColumn("dev", F.col("o_totalprice") - 150000), "o_orderstatus", "dev").select("o_orderstatus", "n", "worst")


@query("select o_orderpriority, o_orderstatus, count(*) n_products from orders group by all")
def progress_counts(s, d):
    return qc.progress_counts(t(s, d, "orders"), ["o_orderpriority", "o_orderstatus"])


@query("""select o_orderpriority, round(avg(x), 6) mean_s, round(median(x), 6) median_s, count(*) n
from (select o_orderpriority, case when o_custkey % 7 = 0 then 0 when o_custkey % 11 = 0 then null else o_totalprice end x from orders) where x <> 0 group by 1""")
def run_time_stats(s, d):
    x = t(s, d, "orders").withColumn("x", F.when(F.col("o_custkey") % 7 == 0, 0.0).when(F.col("o_custkey") % 11 != 0, F.col("o_totalprice")))
    return qc.run_time_stats(x, "o_orderpriority", "x").select("o_orderpriority", F.round("mean_s", 6).alias("mean_s"), F.round("median_s", 6).alias("median_s"), "n")


@query("""with e as (select min(l_quantity) lo, max(l_quantity) hi from lineitem)
select l_returnflag, cast(case when hi = lo then 0 else least(floor((l_quantity - lo) / ((hi - lo) / 40)), 39) end as bigint) bin, count(*) n from lineitem, e where l_quantity is not null group by 1, 2""")
def histogram_40(s, d):
    return qc.histogram(t(s, d, "lineitem"), "l_quantity", 40, ["l_returnflag"])


@query("""with u as (unpivot (select l_returnflag, l_quantity, l_extendedprice, l_discount from lineitem) on l_quantity, l_extendedprice, l_discount into name measure value v)
select l_returnflag, measure, min(v) lo, round(quantile_cont(v, 0.25), 4) q1, round(quantile_cont(v, 0.5), 4) q2, round(quantile_cont(v, 0.75), 4) q3, max(v) hi from u group by 1, 2""")
def box_by_label(s, d):
    x = qc.box_stats(t(s, d, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice", "l_discount"])
    return x.select("l_returnflag", "measure", "lo", *(F.round(f"q{k}", 4).alias(f"q{k}") for k in (1, 2, 3)), "hi")


@query("select count(*) filter (case when l_tax > 0.05 then l_tax end is null) tax_nulls, count(*) filter (l_discount is null) l_discount_nulls from lineitem")
def null_count(s, d):
    return qc.null_counts(t(s, d, "lineitem").withColumn("tax", F.when(F.col("l_tax") > 0.05, F.col("l_tax"))), ["tax", "l_discount"])


@query("""select l_orderkey, bool_and(l_quantity > 5) quantity, bool_and(l_discount < 0.1) discount, bool_and(l_quantity > 5) and bool_and(l_discount < 0.1) complete from lineitem group by 1""")
def completeness_gate(s, d):
    return qc.completeness(t(s, d, "lineitem"), "l_orderkey", {"quantity": F.col("l_quantity") > 5, "discount": F.col("l_discount") < 0.1})


@query("select l_orderkey, count(*) n_clusters, count(*) filter (l_returnflag = 'N') n_good from lineitem group by 1")
def unit_counts(s, d):
    return qc.unit_counts(t(s, d, "lineitem"), ["l_orderkey"], F.col("l_returnflag") == "N")


@query("""select user_id, count(*) spike_count, round(count(*) / 2592000.0, 12) firing_rate from events group by 1""")
def unit_rate(s, d):
    return qc.unit_rates(t(s, d, "events"), ["user_id"], 2592000.0).withColumn("firing_rate", F.round("firing_rate", 12))


@query("""select o_custkey, count(*) n_intervals, round(sum((o_orderkey % 1000 + 20 - o_orderkey % 500) / 250.0), 6) as seconds from orders group by 1""")
def interval_summary(s, d):
    x = t(s, d, "orders").select("o_custkey", (F.col("o_orderkey") % 500).alias("a"), (F.col("o_orderkey") % 1000 + 20).alias("b"))
    return qc.interval_summary(x, ["o_custkey"], "a", "b", F.lit(250.0)).withColumn("seconds", F.round("seconds", 6))


@query("""select * from (select l_partkey, l_orderkey, l_linenumber, l_quantity from lineitem qualify row_number() over (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber) = 1)""")
def first_row_per_key(s, d):
    return qc.first_per_key(t(s, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate"), ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"]).drop("l_shipdate")
