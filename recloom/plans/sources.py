"""Scans and round trips: tables written below the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from recloom.operators import qc
from recloom.plans.base import query, t
from recloom.plans.events import DAY, spikes
from recloom.sources import files, readers, writers
from recloom.sources.scratch import folder


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice > 200000")
def scan_filtered(s, d):
    x = readers.parquet(s, f"{d}/orders.parquet", "o_orderkey long, o_orderstatus string, o_totalprice double")
    return x.filter("o_orderstatus = 'F' and o_totalprice > 200000").select("o_orderkey", "o_totalprice")


@query("select c_custkey, c_name, c_acctbal from customer")
def roundtrip_csv(s, d):
    path = folder(s, "csv")
    writers.csv(t(s, d, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return readers.csv(s, path, "c_custkey long, c_name string, c_acctbal double")


@query("select o_orderkey, o_custkey, o_orderpriority, o_orderstatus from orders")
def roundtrip_by_key(s, d):
    path = folder(s, "keys")
    o = t(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    writers.by_key(o.filter("o_orderstatus != 'P'"), path, ["o_orderstatus"])
    done = s.read.parquet(path).select("o_orderstatus").distinct()
    writers.by_key(o, path, ["o_orderstatus"], done)
    return readers.parquet(s, path).select(*o.columns)


@query("select p_partkey, p_name, case when p_partkey % 2 = 0 then p_size end size, case when p_partkey % 2 = 1 then p_retailprice end price from part")
def roundtrip_shards(s, d):
    path, p = folder(s, "shards"), t(s, d, "part")
    p.filter("p_partkey % 2 = 0").select("p_partkey", "p_name", F.col("p_size").alias("size")).write.parquet(f"{path}/k=0")
    p.filter("p_partkey % 2 = 1").select("p_partkey", "p_name", F.col("p_retailprice").alias("price")).write.parquet(f"{path}/k=1")
    return readers.shards(s, path).select("p_partkey", "p_name", "size", "price")


@query("select vec_id, round(list_sum([z::double for z in embedding]), 5) total, 64::integer n from embeddings")
def roundtrip_vectors(s, d):
    path = folder(s, "vectors")
    writers.both_precisions(t(s, d, "embeddings").select("vec_id", "embedding"), path, ["embedding"])
    x = readers.parquet(s, f"{path}/float32")
    return x.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, z: a + z.cast("double")), 5).alias("total"), F.size("embedding").alias("n"))


@query("""with x as (select vec_id, u.i::integer pos, embedding[u.i + 1]::double v from embeddings, (select unnest(range(64)) i) u),
y as (select *, pow(2::double, case when v = 0 then -24 else greatest(floor(log2(abs(v))), -14) - 10 end) unit from x) select vec_id, pos, round_even(v / unit, 0) * unit v from y""")
def half_precision(s, d):
    """K5: ten bits after the leading one, halves to even."""
    path = folder(s, "halves")
    writers.both_precisions(t(s, d, "embeddings").select("vec_id", "embedding"), path, ["embedding"])
    return readers.parquet(s, f"{path}/float16").select("vec_id", F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))


@query("select 'n' || n_nationkey::varchar k, n_name from nation where n_nationkey % 3 <> 2")
def merged_shards(s, d):
    n = t(s, d, "nation").select("n_nationkey", "n_name")
    names = n.filter("n_nationkey % 3 != 2").select("n_nationkey", F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("k"))
    return writers.merged([n.filter("n_nationkey < 10"), n.filter("n_nationkey >= 10")], names, "n_nationkey", "k")


@query("select c_custkey, c_name, c_acctbal, n_name from customer left join nation on c_nationkey = n_nationkey")
def annotated_table(s, d):
    c = t(s, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    notes = t(s, d, "customer").join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")
    return writers.annotated(c, notes, "c_custkey")[0]


@query("select o_custkey, case when o_custkey % 10 = 7 then 'failed' else 'ok' end status, count(*) n from orders group by 1, 2")
def run_state(s, d):
    def fit(f):
        if f["o_custkey"].iloc[0] % 10 == 7:
            raise ValueError("bad")
        return {"n": len(f)}

    o = t(s, d, "orders").select("o_custkey", "o_orderkey")
    good, bad = writers.per_key(o, ["o_custkey"], fit, "n long")
    n = o.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return good.select("o_custkey", F.lit("ok").alias("status"), "n").unionByName(bad.select("o_custkey", "status").join(n, "o_custkey"))


@query("select o_orderkey, o_orderpriority from orders where o_orderpriority = (select max(o_orderpriority) from orders)")
def latest_label(s, d):
    return readers.latest(t(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")


@query("with x as (select vec_id channel, u.p i, round(embedding[u.p + 1]::double, 6) v from embeddings, (select unnest(range(64)) p) u) select channel, i::integer i, v from x where i >= 23 and i < 43 and channel not in (0, 1)")
def sample_window(s, d):
    x = t(s, d, "embeddings").select(F.col("vec_id").alias("channel"), F.posexplode("embedding").alias("i", "v")).withColumn("v", F.round(F.col("v").cast("double"), 6))
    return readers.window(x, "i", 10.0, 2.0, 20, 3, [0, 1])


def packed(df, fn):
    """One file per ``name``: ``fn`` makes its bytes of the name's rows, which are one recording's."""
    import pandas as pd

    def run(f):
        return pd.DataFrame({"name": [f["name"].iloc[0]], "content": [fn(f)]})

    return df.groupBy("name").applyInPandas(run, "name string, content binary")


def parquet_bytes(f):
    import io

    out = io.BytesIO()
    f.drop(columns="name").to_parquet(out, index=False)
    return out.getvalue()


def vector_bytes(f, kind=None):
    import io

    import numpy as np

    a = np.stack(list(f.sort_values("vec_id")["embedding"]))
    if kind:
        return a.astype(kind).tobytes()
    out = io.BytesIO()
    np.save(out, a)
    return out.getvalue()


@query("""with e as (select event_type, user_id, event_id, value, epoch_us(ts) // 86400000000 dd from events) select event_type subject, 'p' || (user_id % 10)::varchar pid, dd * 86400.0::double t0, event_id, value from e""")
def keyed_tree(s, d):
    """S3: a folder per event type, tenth of the users and day, in it that day's events."""
    root, day = folder(s, "tree"), F.floor(F.col("tm") / DAY).cast("long")
    x = spikes(s, d).select(F.concat_ws("/", "event_type", F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string")), F.concat(F.lit("T"), (day * 86_400_000).cast("string")), F.lit("ap.pqt")).alias("name"), "event_id", "value")
    files.write(packed(x, parquet_bytes), root)
    return readers.keyed_tree(s, root, "ap.pqt").select("subject", "pid", "t0", "event_id", "value")


@query("""with x as (select 'set_' || label::varchar || '.npy' as file, row_number() over (partition by label order by vec_id) - 1 r, count(*) over (partition by label) n, embedding from embeddings)
select file, n rows, 64::bigint columns, round(sum((r + 1) * list_sum([z::double for z in embedding])), 5) weighted from x group by 1, 2""")
def npy_files(s, d):
    """An array per label, read by ranges; a value's row is its place over 64."""
    root = folder(s, "npy")
    x = t(s, d, "embeddings").select(F.concat(F.lit("set_"), F.col("label").cast("string"), F.lit(".npy")).alias("name"), "vec_id", "embedding")
    files.write(packed(x, vector_bytes), root)
    v = files.npy(s, root, values=1000).select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "shape", "at", F.posexplode("values").alias("k", "v"))
    row = F.floor((F.col("at") + F.col("k")) / 64) + 1
    return v.groupBy("file", F.col("shape")[0].alias("rows"), F.col("shape")[1].alias("columns")).agg(F.round(F.sum(row * F.col("v")), 5).alias("weighted"))


@query("""with x as (select 'rec_' || label::varchar || '.bin' as file, row_number() over (partition by label order by vec_id) - 1 i, embedding from embeddings)
select file, i, round(list_sum([z::double for z in embedding]), 5) total, round(embedding[1]::double, 6) first from x""")
def raw_files(s, d):
    """A flat file per label, samples of 64 channels, read by ranges."""
    root = folder(s, "raw")
    x = t(s, d, "embeddings").select(F.concat(F.lit("rec_"), F.col("label").cast("string"), F.lit(".bin")).alias("name"), "vec_id", "embedding")
    files.write(packed(x, lambda f: vector_bytes(f, "float32")), root)
    v = files.raw(s, root, 64, "float32", samples=16)
    total = F.aggregate("v", F.lit(0.0), lambda a, z: a + z)
    return v.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "i", F.round(total, 5).alias("total"), F.round(F.col("v")[0], 6).alias("first"))


@query("select 'lab' || c_nationkey::varchar lab, c_name subject, '2020-01-0' || (c_custkey % 9 + 1)::varchar as date, lpad((c_custkey % 4)::varchar, 3, '0') number from customer")
def path_list(s, d):
    """A list of paths, with remarks between them."""
    root, k = folder(s, "list"), F.col("c_custkey")
    path = F.concat(F.lit("/mnt/lab"), F.col("c_nationkey").cast("string"), F.lit("/Subjects/"), F.col("c_name"), F.lit("/2020-01-0"), (k % 9 + 1).cast("string"), F.lit("/"), F.lpad((k % 4).cast("string"), 3, "0"), F.lit("/raw"))
    t(s, d, "customer").select(F.explode(F.array(F.lit("# one more"), path, F.lit(""))).alias("value")).write.text(root)
    return readers.path_list(s, root).select("lab", "subject", "date", "number")


@query("select o_custkey, case when o_custkey % 5 > 0 then round(max(o_totalprice) / 3600, 2) end as hours from orders group by 1")
def log_files(s, d):
    """A log per customer, a thousand of them in a folder; each fifth was killed before its last line."""
    root = folder(s, "logs")
    x = t(s, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("x"), F.count("*").alias("n"))
    last = F.when(F.col("o_custkey") % 5 > 0, F.concat(F.lit("done in "), F.format_string("%.2f", "x"), F.lit(" s\n"))).otherwise("no more space\n")
    text = F.concat(F.lit("start\n"), F.format_string("read %d in 3 s\n", "n"), last)
    own = F.expr("o_custkey div 1000")  # no folder grows with the customers, and each has one task that writes it
    x = x.select("*", own.alias("own")).repartition(4 * s.sparkContext.defaultParallelism, "own").sortWithinPartitions("own")
    name = F.concat(F.col("own").cast("string"), F.lit("/run_"), F.col("o_custkey").cast("string"), F.lit(".log"))
    files.write(x.select(name.alias("name"), F.encode(text, "UTF-8").alias("content")), root)
    got = readers.log_durations(s, root, "*.log")
    return got.select(F.regexp_extract("path", r"run_(\d+)\.log$", 1).cast("long").alias("o_custkey"), "hours")


@query("select page_id, case when lower(f) like '%page=1%' then 'first' else 'later' end pass, case when lower(f) like '%ref%' then 'linked' when lower(f) like '%page%' then 'paged' end subset from (select page_id, regexp_extract(url, '[^/]*$') f from pages)")
def name_tags(s, d):
    """S4."""
    tags = {"pass": {"PAGE=1": "first", "": "later"}, "subset": {"ref": "linked", "page": "paged"}}
    return readers.with_tags(t(s, d, "pages"), tags, "url").select("page_id", "pass", "subset")


@query("""with x as (select l_returnflag f, l_linestatus k, string_agg(l_orderkey::varchar || ',' || l_linenumber::varchar || ',' || l_partkey::varchar, chr(10) order by l_orderkey, l_linenumber, l_partkey, l_suppkey) || chr(10) c from lineitem group by 1, 2),
h as (select f, 'part_' || k || '.csv' as file, md5(c) md5 from x) select f, file, md5, md5(string_agg(md5, '' order by md5) over (partition by f rows between unbounded preceding and unbounded following)) folder_md5 from h""")
def file_checksums(s, d):
    """a file per flag and status, below a folder per flag."""
    root = folder(s, "sums")
    line = F.concat_ws(",", "l_orderkey", "l_linenumber", "l_partkey")
    name = F.concat(F.col("l_returnflag"), F.lit("/part_"), F.col("l_linestatus"), F.lit(".csv"))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    files.write_lines(t(s, d, "lineitem").select(name.alias("name"), *order, line.alias("line")), root, order)
    own, folders = readers.checksums(s, root, "*.csv")
    own = own.select("md5", F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("f"), F.regexp_extract("path", "[^/]+$", 0).alias("file"))
    return own.join(folders.select(F.regexp_extract("folder", "[^/]+$", 0).alias("f"), F.col("md5").alias("folder_md5")), "f").select("f", "file", "md5", "folder_md5")


@query("""select o_orderpriority, count(*) n, count(*) filter (o_orderstatus = 'F') n_dead, count(*) filter (o_orderstatus = 'P') n_noisy, (o_orderkey % 4)::integer task from orders group by o_orderpriority, o_orderkey % 4""")
def count_tables(s, d):
    """Each of four tasks leaves a table of counts, and all are read as one."""
    path = folder(s, "counts")
    for task in range(4):
        own = t(s, d, "orders").filter(F.col("o_orderkey") % 4 == task)
        writers.table(qc.label_counts(own, ["o_orderpriority"], "o_orderstatus", {"dead": "F", "noisy": "P"}, "O"), f"{path}/task={task}")
    return s.read.parquet(path).select("o_orderpriority", "n", "n_dead", "n_noisy", "task")
