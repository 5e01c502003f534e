"""Keyed joins, guards, patches and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from recloom.operators import tables
from recloom.functions import numbers, text
from recloom.operators import behaviour as bh
from recloom.plans.base import query, t


def unit_tables(s, d):
    """Units are customers, whose nation is their channel."""
    clusters = t(s, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name", F.col("c_nationkey").alias("nationkey"))
    return clusters, t(s, d, "nation").select(F.col("n_nationkey").alias("nationkey"), "n_name")


@query("""with a as (select l_partkey k, sum(l_quantity) v from lineitem where l_returnflag = 'A' group by 1), b as (select l_partkey k, sum(l_quantity) v from lineitem where l_returnflag = 'N' group by 1),
c as (select l_partkey k, count(*) n from lineitem where l_returnflag = 'R' group by 1)
select k, a.v v_x, b.v v_y, n from a full join b using (k) full join c using (k)""")
def outer_merge_features(s, d):
    li = t(s, d, "lineitem").withColumnRenamed("l_partkey", "k")
    part = lambda f: li.filter(F.col("l_returnflag") == f).groupBy("k")
    return tables.outer_merge([part("A").agg(F.sum("l_quantity").alias("v")), part("N").agg(F.sum("l_quantity").alias("v")), part("R").agg(F.count("*").alias("n"))], ["k"])


_POINTS = "select p_partkey % 5 pid, p_partkey, p_size::bigint x, floor(p_retailprice)::bigint y from part"


@query(f"""with p as ({_POINTS}), tb as (select pid, x + 7 x, y - 13 y, p_partkey ord, 'r' || (p_partkey % 3)::varchar acronym from p where not (pid = 4 and p_partkey % 3 <> 0)),
sh as (select a.pid, round_even(a.mx - b.mx, 0)::bigint sx, round_even(a.my - b.my, 0)::bigint sy from (select pid, median(x) mx, median(y) my from p group by 1) a join (select pid, median(x) mx, median(y) my from tb group by 1) b using (pid)),
mv as (select tb.pid, tb.x + sx x, tb.y + sy y, acronym from tb join sh using (pid) qualify row_number() over (partition by tb.pid, tb.x, tb.y order by ord desc) = 1),
j as (select p.*, acronym, (acronym is not null)::int hit from p left join mv using (pid, x, y))
select pid, p_partkey, x, y, coalesce(acronym, 'void') acronym, hit = 1 matched from j qualify avg(hit) over (partition by pid) >= 0.5""")
def position_join(s, d):
    p = t(s, d, "part").select((F.col("p_partkey") % 5).alias("pid"), "p_partkey", F.col("p_size").cast("long").alias("x"), F.floor("p_retailprice").cast("long").alias("y"))
    other = p.filter(~((F.col("pid") == 4) & (F.col("p_partkey") % 3 != 0))).select("pid", (F.col("x") + 7).alias("x"), (F.col("y") - 13).alias("y"), F.col("p_partkey").alias("order"), F.concat(F.lit("r"), (F.col("p_partkey") % 3).cast("string")).alias("acronym"))
    return tables.position_join(p, other, "pid", ["x", "y"], 0.5, {"acronym": "void"})


@query("""with a as (select s_nationkey k, s_name v from supplier), b as (select c_nationkey k, c_name v from customer)
select k, v, 0 priority from a union all select k, v, 1 from b where k not in (select k from a)""")
def fallback_source(s, d):
    a = t(s, d, "supplier")
    return tables.fallback(a.select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("v")), t(s, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("v")), "k")


@query("""with a as (select p_partkey k, p_brand brand, md5(p_name) h from part), b as (select p_partkey k, p_brand brand, md5(case when p_partkey % 50 = 0 then 'new' else p_name end) h from part where p_partkey % 77 <> 0)
select coalesce(a.brand, b.brand) brand, count(*) filter (a.h is distinct from b.h) n_bad from a full join b on a.k = b.k group by 1""")
def identity_guard(s, d):
    p = t(s, d, "part")
    a = p.select("p_brand", "p_partkey", F.md5(F.col("p_name").cast("binary")).alias("h"))
    b = p.filter("p_partkey % 77 <> 0").select("p_brand", "p_partkey", F.md5(F.when(F.col("p_partkey") % 50 == 0, "new").otherwise(F.col("p_name")).cast("binary")).alias("h"))
    return tables.identity_guard(a, b, ["p_brand", "p_partkey"], "h").groupBy(F.col("p_brand").alias("brand")).agg(F.count_if("_bad").alias("n_bad"))


@query("""select p.p_partkey, p_name, n_sold, round(mean_q, 6) mean_q from part p left join (select l_partkey, count(*) n_sold, avg(l_quantity) mean_q from lineitem group by 1) on p_partkey = l_partkey""")
def column_patch(s, d):
    old = t(s, d, "part").select("p_partkey", "p_name", F.lit(1).alias("rp2_a"), F.lit(2).alias("rp2_b"))
    new = t(s, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n_sold"), F.round(F.avg("l_quantity"), 6).alias("mean_q"))
    return tables.patch_columns(old, new, ["p_partkey"], "rp2_")


@query("""with a as (select doc_id, md5(text) one from documents), b as (select doc_id, case when doc_id % 10 = 3 then 'x' else md5(text) end two from documents where doc_id % 50 <> 0), c as (select doc_id, md5(text) three from documents)
select doc_id, one, two, three from a full join b using (doc_id) full join c using (doc_id) where one is distinct from two or one is distinct from three""")
def checksum_reconcile(s, d):
    doc = t(s, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    two = doc.filter("doc_id % 50 <> 0").withColumn("h", F.when(F.col("doc_id") % 10 == 3, "x").otherwise(F.col("h")))
    return tables.reconcile({"one": doc, "two": two, "three": doc}, "doc_id", "h")


@query("select c_custkey, c_name, n_name, n_regionkey from customer left join nation on c_nationkey = n_nationkey")
def unit_left_join(s, d):
    n = t(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    return tables.left_by_key(t(s, d, "customer").select("c_custkey", "c_name", "c_nationkey"), n, ["c_nationkey"]).drop("c_nationkey")


@query("select s_suppkey, n_name from supplier join nation on s_nationkey = n_nationkey")
def strict_lookup(s, d):
    n = t(s, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return tables.strict_lookup(t(s, d, "supplier").select("s_suppkey", "s_nationkey"), n, "s_nationkey").select("s_suppkey", "n_name")


@query("select n_nationkey, array_to_string(list(s_name order by s_suppkey), ',') names from nation join supplier on n_nationkey = s_nationkey group by 1")
def list_per_session(s, d):
    x = tables.rows_sorted(t(s, d, "supplier"), "s_nationkey", "s_suppkey", "s_name")
    n = t(s, d, "nation").select("n_nationkey")
    return n.join(x, n["n_nationkey"] == x["s_nationkey"]).select("n_nationkey", F.array_join("values", ",").alias("names"))


@query("""with l as (select s_nationkey k, s_suppkey % 3 pr, s_name p from supplier where s_suppkey % 4 <> 0)
select n_nationkey, arg_min(p, (pr, p)) path from nation left join l on n_nationkey = k group by 1""")
def search_path(s, d):
    listing = t(s, d, "supplier").filter("s_suppkey % 4 <> 0").select(F.col("s_nationkey").alias("n_nationkey"), (F.col("s_suppkey") % 3).alias("pr"), F.col("s_name").alias("path"))
    return tables.search_path(t(s, d, "nation").select("n_nationkey"), listing, "n_nationkey", "path", "pr")


@query("""select user_id, spike_count, c_name, n_name from (select user_id, count(*) spike_count from events group by 1) left join customer on user_id = c_custkey left join nation on c_nationkey = n_nationkey""")
def merged_units(s, d):
    clusters, channels = unit_tables(s, d)
    return tables.merged_units(t(s, d, "events"), clusters, channels, [], "user_id", "nationkey").drop("nationkey")


@query("select p_partkey, b.i::integer band_index, (['delta', 'theta', 'beta', 'gamma'])[b.i + 1] band from part, (select unnest(range(4)) i) b")
def band_channel_cross(s, d):
    return tables.with_bands(t(s, d, "part").select("p_partkey"), ("delta", "theta", "beta", "gamma"))


@query("""with g as (select l_orderkey, l_linenumber, l_quantity from lineitem), h as (select l_orderkey, l_linenumber, l_tax from lineitem where l_linenumber <= 3) select * from g join h using (l_orderkey, l_linenumber)""")
def common_grid(s, d):
    li = t(s, d, "lineitem")
    return tables.common_grid(li.select("l_orderkey", "l_linenumber", "l_quantity"), li.filter("l_linenumber <= 3").select("l_orderkey", "l_linenumber", "l_tax"), ["l_orderkey", "l_linenumber"])


@query("""with q as (select o_custkey, o_orderpriority tier, round(avg(o_totalprice), 4) v from orders group by 1, 2)
select a.o_custkey, a.tier, round(a.v - b.v, 4) d_v from q a join q b on a.o_custkey = b.o_custkey and b.tier = '1-URGENT' where a.tier <> '1-URGENT'""")
def tier_compare(s, d):
    q = t(s, d, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("tier")).agg(F.round(F.avg("o_totalprice"), 4).alias("v"))
    return tables.tier_differences(q, "tier", ["o_custkey"], ["v"], "1-URGENT").withColumn("d_v", F.round("d_v", 4))


@query("select label, array_to_string(list(vec_id order by vec_id), ',') ids from embeddings group by 1")
def rows_sorted_per_key(s, d):
    return tables.rows_sorted(t(s, d, "embeddings").withColumn("v", F.col("vec_id").cast("string")), "label", "vec_id", "v").select("label", F.array_join("values", ",").alias("ids"))


@query("select c_custkey k, c_name name from customer union all select s_suppkey, s_name from supplier")
def union_all(s, d):
    return tables.union_rows([t(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), t(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))])


@query("select c_nationkey k from customer union select s_nationkey from supplier")
def distinct_keys(s, d):
    return tables.distinct_keys([t(s, d, "customer").withColumnRenamed("c_nationkey", "k"), t(s, d, "supplier").withColumnRenamed("s_nationkey", "k")], "k")


@query("select distinct c_custkey k from customer where c_custkey not in (select s_suppkey from supplier)")
def set_difference(s, d):
    return tables.keys_without(t(s, d, "customer").withColumnRenamed("c_custkey", "k"), t(s, d, "supplier").withColumnRenamed("s_suppkey", "k"), "k")


@query("select l_orderkey, l_linenumber, coalesce(case when l_returnflag = 'R' then l_discount end, 0) - coalesce(case when l_returnflag = 'A' then l_tax end, 0) signed from lineitem")
def signed_difference(s, d):
    x = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", F.col("l_discount")).alias("right"), F.when(F.col("l_returnflag") == "A", F.col("l_tax")).alias("left"))
    return x.select("l_orderkey", "l_linenumber", bh.signed_difference("right", "left").alias("signed"))


@query("select l_orderkey as order_id, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag from lineitem")
def rename_drop(s, d):
    return tables.reshaped(t(s, d, "lineitem"), {"l_orderkey": "order_id"}, ("l_ship", "l_part", "l_supp", "l_linestatus"))


@query("select l_orderkey, l_linenumber, case l_returnflag when 'N' then 0.1 when 'R' then 10.0 end::double lam from lineitem")
def map_lookup(s, d):
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", tables.map_lookup(F.col("l_returnflag"), {"N": 0.1, "R": 10.0}).alias("lam"))


@query("select l_orderkey, l_linenumber, 'run1' pid, l_orderkey * 100 + l_linenumber t0 from lineitem")
def constant_key(s, d):
    return tables.keyed(t(s, d, "lineitem").select("l_orderkey", "l_linenumber"), pid="run1", t0=F.col("l_orderkey") * 100 + F.col("l_linenumber"))


@query("select o_orderkey, o_totalprice price, null::double missing from orders")
def column_by_suffix(s, d):
    return tables.by_suffix(tables.by_suffix(t(s, d, "orders").select("o_orderkey", "o_totalprice"), "price", "price"), "_nothing", "missing").drop("o_totalprice")


@query("""select l_orderkey, l_linenumber, round(ln(l_extendedprice), 6) log_price, greatest(-1, least(1, l_discount * 20 - 1)) clipped, ceil(l_quantity)::bigint up, round(cos(l_quantity), 6) cosine, round_even(l_quantity / 2, 0) half from lineitem""")
def scalar_math(s, d):
    return t(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(numbers.log_size(F.col("l_extendedprice")), 6).alias("log_price"), numbers.clipped(F.col("l_discount") * 20 - 1).alias("clipped"),
        F.ceil("l_quantity").alias("up"), F.round(F.cos("l_quantity"), 6).alias("cosine"), F.bround(F.col("l_quantity") / 2, 0).alias("half"),
    )


@query("""select page_id, case when starts_with(split_part(url, '/', 3), 'm.') then '/mobile' else '/desktop' end || '/' || regexp_replace(split_part(url, '/', 4) || '/' || split_part(url, '/', 5), '/[^/]*$', '') folder from pages""")
def repo_paths(s, d):
    roots = s.createDataFrame([(True, "/mobile"), (False, "/desktop")], "mobile boolean, root string")
    host, rel = F.split_part("url", F.lit("/"), F.lit(3)), F.concat_ws("/", F.split_part("url", F.lit("/"), F.lit(4)), F.split_part("url", F.lit("/"), F.lit(5)))
    x = t(s, d, "pages").select("page_id", host.startswith("m.").alias("mobile"), rel.alias("rel"))
    return tables.repository_folders(x, roots, "mobile", "root", "rel").select("page_id", "folder")


@query("select lower(split_part(url, '/', 3)) host, min(url) first_url from pages where url like '%top' group by 1")
def first_by_suffix(s, d):
    x = t(s, d, "pages").select(text.plain_name(F.split_part("url", F.lit("/"), F.lit(3))).alias("host"), "url")
    return tables.first_with_ending(x, ["host"], "url", "top").withColumnRenamed("url", "first_url")
