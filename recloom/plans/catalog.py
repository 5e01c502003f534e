"""Catalogue, triage and state.  Sessions are orders, their datasets line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from recloom.functions import text
from recloom.operators import catalog, tables
from recloom.plans.base import query, t


@query("""with f as (select l_orderkey, bool_or(l_returnflag = 'N') has_trials, bool_or(l_returnflag = 'A') ok_bpod, bool_or(l_linestatus = 'F') ok_fpga from lineitem group by 1)
select o_orderkey, coalesce(has_trials, false) and not (coalesce(ok_bpod, false) or coalesce(ok_fpga, false)) todo from orders left join f on o_orderkey = l_orderkey""")
def triage_todo(s, d):
    f = catalog.group_flags(t(s, d, "lineitem"), ["l_orderkey"], {"has_trials": F.col("l_returnflag") == "N", "ok_bpod": F.col("l_returnflag") == "A", "ok_fpga": F.col("l_linestatus") == "F"})
    o = t(s, d, "orders").select("o_orderkey")
    return o.join(f, o["o_orderkey"] == f["l_orderkey"], "left").select("o_orderkey", catalog.todo(F.col("has_trials"), F.col("ok_bpod"), F.col("ok_fpga")).alias("todo"))


@query("""with p as (select l_orderkey, l_linestatus, l_returnflag, bool_or(coalesce(l_quantity > 10, false)) ok from lineitem group by 1, 2, 3)
select l_orderkey, bool_and(ok) and count(distinct l_returnflag) = 2 skip from p group by 1""")
def check_skip(s, d):
    return catalog.check_skip(t(s, d, "lineitem"), "l_orderkey", "l_linestatus", "l_returnflag", F.col("l_quantity") > 10, 2)


@query("select l_orderkey, count(*) filter (l_shipdate > timestamp '1997-01-01') n_matches, count(*) filter (l_shipdate > timestamp '1997-01-01') = 4 has_all from lineitem group by 1")
def revision_count(s, d):
    return catalog.count_equals(t(s, d, "lineitem"), ["l_orderkey"], F.col("l_shipdate") > F.lit("1997-01-01").cast("timestamp_ntz"), 4)


@query("select l_orderkey, count(*) filter (l_quantity > 20) n_matches, count(distinct case when l_quantity > 20 then l_returnflag end) = 2 has_all from lineitem group by 1")
def revision_names(s, d):
    return catalog.count_equals(t(s, d, "lineitem"), ["l_orderkey"], F.col("l_quantity") > 20, 2, F.col("l_returnflag"))


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def missing_keys(s, d):
    return catalog.missing_keys(t(s, d, "customer").select("c_custkey"), t(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders)")
def ready_keys(s, d):
    return catalog.ready_keys(t(s, d, "customer").select("c_custkey"), t(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("select o_orderkey, o_custkey from orders where o_orderkey not in (select l_orderkey from lineitem group by 1 having count(*) >= 4)")
def resume_filter(s, d):
    done = t(s, d, "lineitem").groupBy("l_orderkey").count().filter("count >= 4").select(F.col("l_orderkey").alias("o_orderkey"))
    return catalog.missing_keys(t(s, d, "orders").select("o_orderkey", "o_custkey"), done, "o_orderkey")


@query("select o_custkey from orders where o_orderpriority in ('1-URGENT', '2-HIGH') group by 1 having count(distinct o_orderpriority) = 2")
def superset_keys(s, d):
    return catalog.superset_keys(t(s, d, "orders"), "o_custkey", "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("select l_orderkey, count(*) n_products from lineitem group by 1 having not bool_or(l_returnflag = 'R')")
def incomplete_products(s, d):
    return catalog.incomplete(t(s, d, "lineitem"), "l_orderkey", "l_returnflag", "R")


@query("select c_custkey, c_mktsegment from customer where c_mktsegment is distinct from 'BUILDING'")
def not_empty(s, d):
    return catalog.keep_not_equal(t(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "BUILDING")


@query("select c_custkey from customer where c_custkey not in (1, 5, 8, 13)")
def exclude_keys(s, d):
    return catalog.exclude(t(s, d, "customer").select("c_custkey"), "c_custkey", [1, 5, 8, 13])


@query("select l_orderkey, l_linenumber from lineitem where l_returnflag = 'N'")
def good_only(s, d):
    return catalog.good_units(t(s, d, "lineitem"), "l_returnflag", "N").select("l_orderkey", "l_linenumber")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def first_n(s, d):
    return catalog.first_n(t(s, d, "orders").select("o_orderkey", "o_totalprice"), 25, F.desc("o_totalprice"), "o_orderkey")


@query("select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) - 1 rn from orders) where rn % 7 = 3")
def every_nth(s, d):
    return catalog.every_nth(t(s, d, "orders").select("o_orderkey"), "o_orderkey", 7, 3)


@query("select o_orderkey, o_custkey from orders where o_custkey in (select distinct o_custkey from orders order by 1 limit 20)")
def first_n_groups(s, d):
    return catalog.first_n_groups(t(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 20)


@query("""select n, n_groups, (s // 3600)::varchar || ':' || lpad((s // 60 % 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') estimate
from (select count(*) n, count(distinct o_custkey) n_groups, floor(count(*) * 40.0 / 48)::bigint s from orders)""")
def time_estimate(s, d):
    return catalog.time_estimate(t(s, d, "orders"), "o_custkey", 40.0, 48)


@query("""with x as (select o_orderkey, floor(o_totalprice)::bigint s from orders)
select o_orderkey, (s // 3600)::varchar || ':' || lpad((s // 60 % 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') txt from x""")
def duration_text(s, d):
    return t(s, d, "orders").select("o_orderkey", catalog.duration_text(F.col("o_totalprice")).alias("txt"))


@query("select c_custkey, u.i::integer snippet_index, ([300, 900, 1500, 2100, 3000])[u.i + 1]::integer t_start from customer, (select unnest(range(5)) i) u")
def window_grid(s, d):
    return catalog.window_grid(t(s, d, "customer").select("c_custkey"), [300, 900, 1500, 2100, 3000])


@query("select c_custkey, b.i::integer blk, u.p::integer pseudo_id from customer, (select unnest(range(3)) i) b, (select unnest(range(-1, 12)) p) u where u.p >= b.i * 4 and u.p < b.i * 4 + 4 or u.p = -1 and b.i = 0")
def pseudo_grid(s, d):
    return catalog.session_grid(t(s, d, "customer").select("c_custkey"), 3, 4)


@query("""select event_id, unnest(case when value <= 20 and value >= 80 then ['early', 'late', 'all'] when value <= 20 then ['early', 'all'] when value >= 80 then ['late', 'all'] else ['all'] end) subset from events""")
def range_subsets(s, d):
    return catalog.named_ranges(t(s, d, "events").select("event_id", "value"), "value", 20, 80).select("event_id", "subset")


@query("""with old as (select o_custkey k, o_orderdate w, o_totalprice v from orders where o_orderkey % 2 = 0), new as (select o_custkey k, o_orderdate w, o_totalprice v from orders where o_orderkey % 2 = 1),
a as (select k, max(w) w, max(v) v from old group by 1), b as (select k, max(w) w, max(v) v from new group by 1)
select k, w, v from (select *, 0 f from a union all select *, 1 f from b) qualify row_number() over (partition by k order by w desc, f desc) = 1""")
def newer_wins(s, d):
    o = t(s, d, "orders")
    half = lambda k: o.filter(F.col("o_orderkey") % 2 == k).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderdate").alias("w"), F.max("o_totalprice").alias("v"))
    return catalog.newer_wins(half(0), half(1), "k", "w")


@query("select page_id, split_part(url, '/', 3) host, split_part(url, '/', 4) first_part, regexp_replace(url, '/[^/]*$', '') parent from pages")
def path_parts(s, d):
    u = F.col("url")
    return t(s, d, "pages").select("page_id", text.path_part(u, 3).alias("host"), F.coalesce(text.path_part(u, 4), F.lit("")).alias("first_part"), text.parent(u).alias("parent"))


@query("select event_id, (props ->> '$.k')::bigint k from events where props <> ''")
def json_fields(s, d):
    return t(s, d, "events").filter("props <> ''").select("event_id", text.json_fields(F.col("props"), "k long")["k"].alias("k"))


@query("select page_id from pages where lower(url) like 'https%' and lower(url) like '%example%' and not lower(url) like '%top'")
def text_predicates(s, d):
    return t(s, d, "pages").filter(catalog.text_match("url", "HTTPS", None, "Example") & ~catalog.text_match("url", None, "TOP")).select("page_id")


@query("""select conv_id, round(length(text) / 3600.0, 2) as hours from conversations qualify row_number() over (partition by conv_id order by turn desc) = 1""")
def last_log_line(s, d):
    last = t(s, d, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    return last.select("conv_id", F.round(F.length("text") / 3600.0, 2).alias("hours"))


@query("""with v as (select o_orderkey, case when o_orderkey % 9 = 0 then null when o_orderkey % 5 = 0 then 'abc' else (o_orderkey % 4)::varchar || '.' || (o_orderkey % 13)::varchar || '.' || (o_custkey % 3)::varchar end v from orders)
select o_orderkey, coalesce((o_orderkey % 9 <> 0 and o_orderkey % 5 <> 0) and (string_split(v, '.')[1]::int > 3 or string_split(v, '.')[1]::int = 3 and string_split(v, '.')[2]::int >= 10), false) recent from (select o_orderkey, case when v = 'abc' then null else v end v from v)""")
def version_compare(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    v = F.when(k % 9 == 0, None).when(k % 5 == 0, "abc").otherwise(F.concat_ws(".", (k % 4).cast("string"), (k % 13).cast("string"), (c % 3).cast("string")))
    return t(s, d, "orders").select("o_orderkey", text.version_at_least(v, "3.10").alias("recent"))


@query("""select o_orderkey, 'T' || lpad((o_custkey * 1000)::varchar, 10, '0') lbl, o_custkey::double as seconds, lpad((o_orderkey % 1000)::varchar, 3, '0') num from orders""")
def label_pad_parse(s, d):
    lbl = text.time_label(F.col("o_custkey").cast("double"))
    return t(s, d, "orders").select("o_orderkey", lbl.alias("lbl"), text.from_time_label(lbl).alias("seconds"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0").alias("num"))


@query("select o_orderkey, split_part(x, '__', 1) subject, split_part(x, '__', 2) as day, split_part(x, '__', 3) number from (select o_orderkey, o_custkey::varchar || '__' || strftime(o_orderdate, '%Y-%m-%d') || '__' || o_orderstatus x from orders)")
def split_key(s, d):
    x = F.concat_ws("__", F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderstatus")
    return t(s, d, "orders").select("o_orderkey", *text.key_fields(x, ["subject", "day", "number"]))


@query("select page_id, case when starts_with(url, 'http://') then '/mnt/' || substr(url, 8) else url end path from pages")
def path_rebase(s, d):
    return t(s, d, "pages").select("page_id", text.rebase(F.col("url"), "http://", "/mnt/").alias("path"))


@query("select o_orderkey, o_orderdate::date > case when o_orderstatus = 'F' then date '1994-06-01' else date '1997-01-01' end late from orders")
def date_rule(s, d):
    late = text.after(F.col("o_orderdate"), "1997-01-01", {"F": "1994-06-01"}, F.col("o_orderstatus"))
    return t(s, d, "orders").select("o_orderkey", late.alias("late"))


@query("select distinct lower(o_orderpriority) name from orders")
def lower_name(s, d):
    return t(s, d, "orders").select(text.plain_name(F.col("o_orderpriority")).alias("name")).distinct()


@query("""select user_id, count(*) filter (value >= 50) / count(*) >= 0.5 has_stream from events group by 1""")
def availability_flags(s, d):
    return t(s, d, "events").groupBy("user_id").agg((F.count_if(F.col("value") >= 50) / F.count("*") >= 0.5).alias("has_stream"))


SETTINGS = [("click", -0.5, 0.0), ("view", 0.0, 0.1), ("purchase", -0.1, 0.4)]


@query("""select event_id, event_type, lo, hi from events join (values ('click', -0.5, 0.0), ('view', 0.0, 0.1), ('purchase', -0.1, 0.4)) c(event_type, lo, hi) using (event_type)""".replace("-0.5, 0.0)", "-0.5::double, 0.0::double)").replace("0.0, 0.1)", "0.0::double, 0.1::double)").replace("-0.1, 0.4)", "-0.1::double, 0.4::double)"))
def settings_join(s, d):
    conf = s.createDataFrame(SETTINGS, "event_type string, lo double, hi double")
    return tables.settings_of(t(s, d, "events").filter("event_type in ('click', 'view', 'purchase')"), conf, "event_type").select("event_id", "event_type", "lo", "hi")


@query("""select o_orderkey, case when n >= 4 then 'Done' when n >= 2 then 'Started' else 'Not started' end status from orders left join (select l_orderkey, count(*) n from lineitem group by 1) on o_orderkey = l_orderkey""")
def status_case(s, d):
    n = t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return t(s, d, "orders").join(n, "o_orderkey", "left").select("o_orderkey", text.status_case(F.col("n") >= 4, F.col("n") >= 2).alias("status"))


@query("select l_orderkey, case when bool_or(l_returnflag = 'R' or l_returnflag = 'A') then 'ephys' else 'behaviour' end revision from lineitem group by 1")
def revision_choice(s, d):
    return catalog.revision_choice(t(s, d, "lineitem"), ["l_orderkey"], "l_returnflag", ["R", "A"], "ephys", "behaviour")


@query("select o_orderkey, case when o_orderpriority like '1%' then 'task_00' when o_orderstatus = 'P' then 'task_01' else 'task' end ns from orders")
def namespace_choice(s, d):
    ns = text.namespace(F.col("o_orderpriority"), {"task_00": "1", "task_01": F.col("o_orderstatus") == "P"}, "task")
    return t(s, d, "orders").select("o_orderkey", ns.alias("ns"))


@query("select event_id, len(list_filter(json_keys(props), lambda x: starts_with(x, 'k'))) n from events where props <> '' and n > 0")
def map_prefix(s, d):
    m = text.with_prefix(F.from_json("props", "map<string,bigint>"), "k")
    return t(s, d, "events").select("event_id", F.size(m).cast("long").alias("n")).filter("n > 0")


@query("select page_id, url from pages where url ilike 'https%' and url ilike '%example%' and page_id >= 10 and page_id % 3 <> 0")
def catalogue(s, d):
    """Several terms at once."""
    x = t(s, d, "pages").select("page_id", "url", (F.col("page_id") % 3 != 0).alias("there"))
    return catalog.catalogue(x, "there", url__startswith="https", url__contains="example", page_id__gte=10).drop("there")


@query("select o_orderkey from orders where o_orderstatus = 'F' and o_orderpriority like '1%'")
def freeze_filter(s, d):
    """The status is the freeze, urgent orders its members."""
    x = t(s, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderpriority").startswith("1").alias("member"))
    return catalog.frozen(x, "F", "o_orderstatus", "member").select("o_orderkey")


@query("select o_orderkey, o_totalprice from orders where o_orderkey in (3, 5, 8, 13, 21, 34) order by o_orderkey limit 4")
def key_list(s, d):
    """The first of an explicit list."""
    return catalog.select_keys(t(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", [3, 5, 8, 13, 21, 34], 4)


_ST = """st as (select o_custkey k, max(o_orderdate) w, arg_max(o_orderstatus, (o_orderdate, o_orderkey % 2)) status from (select o_custkey, o_orderdate, min(o_orderstatus) o_orderstatus, o_orderkey % 2 o_orderkey from orders group by 1, 2, 4) group by 1),
rm as (select c_custkey k from customer where c_custkey % 11 = 0), ss as (select * from st where k not in (select k from rm))"""


def run_states(s, d):
    o = t(s, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("w"), (F.col("o_orderkey") % 2).alias("half")).agg(F.min("o_orderstatus").alias("status"))
    late = lambda half: o.filter(F.col("half") == half).groupBy("k").agg(F.max("w").alias("w"), F.max_by("status", "w").alias("status"))
    customers = t(s, d, "customer").select(F.col("c_custkey").alias("k"))
    return catalog.merged_state(late(0), late(1), "k", "w", customers.filter("k % 11 = 0"), customers, done="F")


@query(f"with {_ST} select k, w, status from ss")
def merged_state(s, d):
    """Orders of even and odd numbers are two runs' states; every eleventh customer is removed."""
    return run_states(s, d)[0]


@query(f"with {_ST} select c_custkey k from customer where c_custkey not in (select k from ss where status = 'F')")
def run_list(s, d):
    """K12."""
    return run_states(s, d)[1]
