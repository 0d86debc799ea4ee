"""Joins, similarity, places and graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marisma.functions import hashing
from marisma.operators import facets, graph, relations, stories
from marisma.plans.kit import docs
from marisma.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""select anchor, peer, turn::int as turn from (select a.event_id as anchor, b.event_id as peer, row_number() over (partition by a.event_id order by date_trunc('second', b.ts) desc, b.event_id) as turn
from events a join events b on a.user_id = b.user_id and a.event_id <> b.event_id and abs(date_diff('second', a.ts, b.ts)) <= 604800 where a.event_type = 'purchase') where turn <= 24""")
def peer_interval_join(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return relations.peers(e.where("event_type = 'purchase'"), e, "user_id", "ts", "event_id", 7, 24)


@query("""select o_orderkey, c_name, n_name, r_name from orders join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey left join region on r_regionkey = n_regionkey where o_orderstatus = 'P' and c_mktsegment = 'BUILDING'""")
def join_filtered(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, n["n_nationkey"] == c["c_nationkey"], "left").join(r, r["r_regionkey"] == n["n_regionkey"], "left")
    return j.select("o_orderkey", "c_name", "n_name", "r_name")


@query("""select o_orderkey, coalesce(string_agg(l_linenumber || ':' || l_returnflag, ',' order by l_linenumber, l_returnflag), '') as lines, count(l_linenumber)::bigint as n from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey""")
def nested_assembly(spark, d):
    o, x = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    lines = x.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("s"))
    j = o.join(lines, o["o_orderkey"] == lines["l_orderkey"], "left")
    shown = F.array_join(F.transform("s", lambda v: F.concat(v["l_linenumber"].cast("string"), F.lit(":"), v["l_returnflag"])), ",")
    return j.select("o_orderkey", F.coalesce(shown, F.lit("")).alias("lines"), F.coalesce(F.size("s"), F.lit(0)).cast("long").alias("n"))


@query("select (select count(*) from customer where c_custkey in (select o_custkey from orders))::bigint as semi, (select count(*) from customer where c_custkey not in (select o_custkey from orders))::bigint as anti, (select count(*) from customer left join orders on o_custkey = c_custkey)::bigint as left_rows")
def semi_anti_left(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    kinds = [c.join(o, "c_custkey", how).agg(F.count(F.lit(1)).alias(name)) for how, name in (("left_semi", "semi"), ("left_anti", "anti"), ("left", "left_rows"))]
    return kinds[0].crossJoin(kinds[1]).crossJoin(kinds[2])


@query("""select 'union' as op, count(*)::bigint as n from (select lang from documents union select role from conversations) union all
select 'intersect', count(*) from (select o_custkey from orders intersect select c_custkey from customer) union all select 'except', count(*) from (select c_custkey from customer except select o_custkey from orders)""")
def set_ops(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select("o_custkey")
    sets = {"union": docs(spark, d).select("lang").union(table(spark, d, "conversations").select("role")).distinct(), "intersect": o.intersect(c), "except": c.subtract(o)}
    out = None
    for k, v in sets.items():
        row = v.agg(F.lit(k).alias("op"), F.count(F.lit(1)).alias("n")).select("op", "n")
        out = row if out is None else out.union(row)
    return out


_HAMMING = " + ".join(f"bit_count(xor(('0x' || substr(a.h, {i}, 8))::bigint, ('0x' || substr(b.h, {i}, 8))::bigint))::bigint" for i in range(1, 64, 8))
_HASHED = "(select doc_id, sha256(text) as h, substr(sha256(text), 1, 8) as g from documents)"


@query(f"select a.doc_id, ({_HAMMING})::bigint as bits, round(100.0::double * (1.0::double - ({_HAMMING}) / 256.0::double), 6) as percent from {_HASHED} a join {_HASHED} b on b.doc_id = a.doc_id + 1")
def hamming_bits(spark, d):
    a = docs(spark, d).select("doc_id", hashing.sha(F.col("text")).alias("a"))
    j = a.join(a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id")
    return j.select("doc_id", hashing.hamming_bits(F.col("a"), F.col("b")).cast("long").alias("bits"), F.round(hashing.similarity_percent(F.col("a"), F.col("b")), 6).alias("percent"))


_NEAR = "(select doc_id, substr(sha256(text), 1, 8) || substr(sha256((doc_id // 10)::varchar), 9) as h from documents)"


@query(f"select a.doc_id as query, b.doc_id as match, 100.0::double * (1.0::double - ({_HAMMING}) / 256.0::double) as similarity from {_NEAR} a join {_NEAR} b on a.doc_id <> b.doc_id where a.doc_id % 20 = 0 and ({_HAMMING}) <= 12")
def near_dup_hash_join(spark, d):
    """Hashes of families of ten whose first 32 bits differ at random."""
    rows = docs(spark, d).select("doc_id", F.concat(F.substring(hashing.sha(F.col("text")), 1, 8), F.substring(hashing.sha(F.floor(F.col("doc_id") / 10).cast("string")), 9, 56)).alias("h"))
    return relations.near_hashes(rows.where("doc_id % 20 = 0"), rows, "doc_id", "h", 100 - 100 * 12 / 256)


_COS = "round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9)"


@query(f"select query, match, floor(1000 * c)::bigint as milli, place::int as place from (select *, row_number() over (partition by query order by c desc, match) as place from (select a.vec_id as query, b.vec_id as match, {_COS} as c from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0)) where place <= 10")
def embedding_cosine_topk(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    top = relations.cosine_pairs(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", most=10)
    return top.select("query", "match", F.floor(F.col("cosine") * 1000).cast("long").alias("milli"), F.col("turn").alias("place"))


@query("""with s as (select a.doc_id as query, b.doc_id as match, 4 * (a.lang = b.lang)::int + 8 * (substr(sha256(a.text), 1, 2) = substr(sha256(b.text), 1, 2))::int + (a.source = b.source)::int as score from documents a join documents b on a.doc_id <> b.doc_id where a.doc_id % 20 = 0)
select query, match, score, place::int as place from (select *, row_number() over (partition by query order by score desc, match) as place from s where score > 0) where place <= 5""")
def similar_items_scored(spark, d):
    rows = docs(spark, d).select("doc_id", F.array("lang").alias("tags"), "source", F.substring(hashing.sha(F.col("text")), 1, 2).alias("h"))
    top = stories.similar(rows.where("doc_id % 20 = 0"), rows, "doc_id", "tags", "h", "source", 5)
    return top.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "match")))


@query("""with t as (select doc_id, min(tier) as tier from (select doc_id, 0 as tier from documents where source = 'src3' and lang = 'fr' union all select doc_id, 1 from documents where source = 'src3' union all select doc_id, 2 from documents) group by doc_id) select doc_id, tier, doc_id as seq from t order by tier, doc_id limit 30""")
def similar_tiered_fallback(spark, d):
    r = docs(spark, d).select("doc_id", "source", "lang").withColumn("seq", F.col("doc_id"))
    return relations.first_tier([r.where("source = 'src3' and lang = 'fr'"), r.where("source = 'src3'"), r], "doc_id", "seq", 30)


_PLACE = "select o_orderkey, o_orderdate, o_orderpriority, o_totalprice, n_name as place from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey"


@query(f"""with p as ({_PLACE}), t as (select place, o_orderpriority as k, count(*) as n from p group by 1, 2), b as (select place, k as top from (select *, row_number() over (partition by place order by n desc, k) as r from t) where r = 1),
f as (select place, string_agg(o_orderkey::varchar, ',' order by r) as first8 from (select place, o_orderkey, row_number() over (partition by place order by o_orderdate, o_orderkey) as r from p) where r <= 8 group by place)
select place, count(*)::bigint as n, min(o_orderdate)::date as first_seen, round_even(avg(o_totalprice) / 1000, 0)::bigint as mean_risk, top, first8 from p join b using (place) join f using (place) group by place, top, first8""")
def geo_rollup_topk(spark, d):
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", F.col("n_name").alias("place"))
    p = o.join(c, F.col("c_custkey") == F.col("o_custkey")).select("place", "o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    by = p.groupBy("place", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.min(F.to_date("o_orderdate")).alias("first_seen"), F.sum("o_totalprice").alias("total"))
    best = by.groupBy("place").agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.bround(F.sum("total") / F.sum("n") / 1000, 0).cast("long").alias("mean_risk"), F.min(F.struct((-F.col("n")).alias("m"), "o_orderpriority")).alias("t"))
    top = facets.top_per_group(p.select("place", "o_orderkey", "o_orderdate"), ["place"], [F.col("o_orderdate"), F.col("o_orderkey")], 8)
    first = top.groupBy("place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string")), ",").alias("first8"))
    return best.join(first, "place").select("place", "n", "first_seen", "mean_risk", F.col("t.o_orderpriority").alias("top"), "first8")


_PLACES = [("edinth", "E"), ("thion", "T"), ("the", "A"), ("ein", "B"), ("que", "C")]


@query("select doc_id, case " + " ".join(f"when contains(lower(text), '{w}') then '{p}'" for w, p in _PLACES) + " end as place from documents")
def geo_priority_resolve(spark, d):
    place = F.lit(None).cast("string")
    for word, name in reversed(_PLACES):
        place = F.when(F.contains(F.lower("text"), F.lit(word)), name).otherwise(place)
    return docs(spark, d).select("doc_id", place.alias("place"))


_LINKS = "(select c_custkey, n_name as x, o_orderpriority as y, o_orderkey as seq, c_mktsegment as label from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey)"
_EDGES = f"(select least(x, y) as a, greatest(x, y) as b, count(*)::bigint as value, arg_min(label, seq) as label from {_LINKS} where x <> y group by 1, 2)"
_NODES = f"(select node, sum(value)::bigint as weight, count(*)::bigint as degree from (select a as node, value from {_EDGES} union all select b, value from {_EDGES}) group by node)"


def _edges(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    links = table(spark, d, "orders").join(c, F.col("c_custkey") == F.col("o_custkey")).select("n_name", "o_orderpriority", "c_mktsegment", "o_orderkey")
    return graph.edges(links, "n_name", "o_orderpriority", "c_mktsegment", "o_orderkey")


@query(f"select * from {_EDGES}")
def graph_edges_dedup(spark, d):
    return _edges(spark, d)


@query(f"select * from {_NODES}")
def graph_node_weight(spark, d):
    return graph.node_weights(_edges(spark, d))


@query(f"with t as (select node from {_NODES} order by weight desc, node limit 12) select a, b, value, label from {_EDGES} where a in (select node from t) and b in (select node from t)")
def graph_prune(spark, d):
    return graph.prune(_edges(spark, d), 12).select("a", "b", "value", "label")


@query("""select n_name, count(*)::bigint as volume, count(distinct c_custkey)::bigint as sources, arg_max(day, (n, -epoch(day))) as peak_day from (select n_name, c_custkey, o_orderdate::date as day, count(*) over (partition by n_name, o_orderdate::date) as n from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey) group by n_name""")
def narrative_rollup_country(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "n_name")
    p = table(spark, d, "orders").join(c, F.col("c_custkey") == F.col("o_custkey")).select("n_name", "c_custkey", F.to_date("o_orderdate").alias("day"))
    days = p.groupBy("n_name", "day").agg(F.count(F.lit(1)).alias("n")).groupBy("n_name").agg(F.sum("n").alias("volume"), F.min(F.struct((-F.col("n")).alias("m"), "day")).alias("peak"))
    return days.join(p.groupBy("n_name").agg(F.countDistinct("c_custkey").alias("sources")), "n_name").select("n_name", "volume", "sources", F.col("peak.day").alias("peak_day"))


@query("""select p_partkey, coalesce(max(l_quantity), 0.0)::double as growth from part left join lineitem on l_partkey = p_partkey and l_returnflag = 'R' group by p_partkey""")
def growth_lookup(spark, d):
    r = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_partkey").agg(F.max("l_quantity").alias("g"))
    return table(spark, d, "part").join(r, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("g", F.lit(0.0)).cast("double").alias("growth"))


@query("""select conv_id, turn, role from conversations where conv_id in (select doc_id from labels where quality = 1) and contains(lower(text), 'th')""")
def member_filter(spark, d):
    members = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("conv_id"))
    return table(spark, d, "conversations").where(F.contains(F.lower("text"), F.lit("th"))).join(members, "conv_id", "left_semi").select("conv_id", "turn", "role")


@query("""with q as (select 'SRC7' as needle union all select 'src12' union all select '3'), c as (select needle, doc_id, case when source = needle then 0 when source = lower(needle) then 1 when doc_id::varchar = needle then 2 end as r from q join documents on source = needle or source = lower(needle) or doc_id::varchar = needle)
select needle, arg_min(doc_id, (r, doc_id)) as doc_id, min(r)::int as how from c group by needle""")
def flexible_lookup(spark, d):
    q = spark.createDataFrame([("SRC7",), ("src12",), ("3",)], "needle string")
    rows = docs(spark, d).select("doc_id", "source")
    keys = [(F.col("needle"), F.col("source")), (F.lower("needle"), F.col("source")), (F.col("needle"), F.col("doc_id").cast("string"))]
    out = None
    for i, (a, b) in enumerate(keys):
        t = rows.join(F.broadcast(q), a == b).select("needle", F.struct(F.lit(i).alias("r"), "doc_id").alias("m"))
        out = t if out is None else out.union(t)
    return out.groupBy("needle").agg(F.min("m").alias("m")).select("needle", F.col("m.doc_id").alias("doc_id"), F.col("m.r").alias("how"))


@query("select doc_id, day, kind from (select doc_id, n_chars % 30 as day, 'published' as kind from documents union all select doc_id, n_chars % 30 + 1, 'labelled' from documents join labels using (doc_id) union all select doc_id, n_chars % 30 + 2, 'toxic' from documents join labels using (doc_id) where toxic = 1)")
def timeline(spark, d):
    r = docs(spark, d).select("doc_id", (F.col("n_chars") % 30).alias("day"))
    j = r.join(table(spark, d, "labels"), "doc_id")
    return r.withColumn("kind", F.lit("published")).unionByName(j.select("doc_id", (F.col("day") + 1).alias("day"), F.lit("labelled").alias("kind"))).unionByName(j.where("toxic = 1").select("doc_id", (F.col("day") + 2).alias("day"), F.lit("toxic").alias("kind")))
