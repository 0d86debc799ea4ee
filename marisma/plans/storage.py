"""Table states after inserts, updates and deletes."""

from __future__ import annotations

from pyspark.sql import functions as F

from marisma.functions import hashing
from marisma.plans.kit import docs
from marisma.sinks import tables
from marisma.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_OLD = "(select c_custkey, case when c_custkey % 11 <> 0 then c_name end as c_name, c_acctbal from customer where c_custkey % 3 <> 0)"
_NEW = "(select case when c_custkey % 13 <> 0 then c_custkey // 2 end as c_custkey, c_name || '!' as c_name, c_nationkey::double as c_acctbal from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0)"


@query(f"""select * from {_OLD} union all select c_custkey, c_name, c_acctbal from (select *, row_number() over (partition by c_custkey order by c_acctbal, c_name) as turn from {_NEW}) where c_custkey is null or turn = 1 and c_custkey not in (select c_custkey from {_OLD})""")
def insert_ignore(spark, d):
    """Two new rows come for a key, with ties in their order, and some without a key."""
    c = table(spark, d, "customer")
    new = c.where("c_custkey % 2 = 0 or c_custkey % 3 = 0").select(F.expr("case when c_custkey % 13 <> 0 then c_custkey div 2 end").alias("c_custkey"), F.concat("c_name", F.lit("!")).alias("c_name"), F.col("c_nationkey").cast("double").alias("c_acctbal"))
    return tables.insert_ignore(c.where("c_custkey % 3 <> 0").select("c_custkey", F.expr("case when c_custkey % 11 <> 0 then c_name end").alias("c_name"), "c_acctbal"), new, ["c_custkey"], "c_acctbal")


@query("""select c_custkey, case when c_custkey % 2 = 0 then c_name || '!' else c_name end as c_name, c_acctbal, case when c_custkey % 3 = 0 then null else c_mktsegment end as c_mktsegment from customer where c_custkey % 2 = 0 or c_custkey % 3 <> 0""")
def upsert_preserve(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    new = c.where("c_custkey % 2 = 0").select("c_custkey", F.concat("c_name", F.lit("!")).alias("c_name"), "c_acctbal")
    return tables.upsert(c.where("c_custkey % 3 <> 0"), new, ["c_custkey"], ["c_name"])


@query("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as r from events) where r = 1")
def replace_last(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return tables.replace_last(e, ["user_id", "event_type"], "event_id")


@query("select (select count(*) from orders where o_orderkey not in (select o_orderkey from orders where o_orderpriority ilike '%urgent%'))::bigint as parents, (select count(*) from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderpriority ilike '%urgent%'))::bigint as children")
def cascade_delete(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority")
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"))
    p, c = tables.cascade_delete(o, x, "k", o.where(F.col("o_orderpriority").ilike("%urgent%")).select("k"))
    return p.agg(F.count(F.lit(1)).alias("parents")).crossJoin(c.agg(F.count(F.lit(1)).alias("children")))


@query("select h as hash from (select sha256(text) as h from documents union select sha256(text) from conversations)")
def mirror_union_hashes(spark, d):
    return docs(spark, d).select(hashing.sha(F.col("text")).alias("hash")).union(table(spark, d, "conversations").select(hashing.sha(F.col("text")))).distinct()


@query("""select s_suppkey, case when s_suppkey % 4 = 0 then 'rss' else 'scrape' end as access, coalesce(n_name, 'XX') as country from supplier left join nation on n_nationkey = s_nationkey union all select -1, 'api', 'INT'""")
def catalog_override_merge(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    rss = s.where("s_suppkey % 4 = 0").select("s_suppkey", F.lit("rss").alias("o"))
    base = s.join(rss, "s_suppkey", "left").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    base = base.select("s_suppkey", F.coalesce("o", F.lit("scrape")).alias("access"), F.coalesce("n_name", F.lit("XX")).alias("country"))
    extra = spark.createDataFrame([(-1, "api", "INT"), (1, "api", "INT")], "s_suppkey bigint, access string, country string")
    return base.unionByName(extra.join(base, "s_suppkey", "left_anti"))
