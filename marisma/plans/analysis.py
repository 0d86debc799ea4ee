"""Claims, narratives, orderings, streams and compositions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marisma.functions import hashing, scoring, text, urls
from marisma.operators import claims, facets, lexicon, relations
from marisma.plans.kit import LEXICON, STOP, docs, hits_sql, tokens_sql, word_sql
from marisma.sources.tables import table
from marisma.streaming import batches

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# distinct in order: DuckDB's list_distinct keeps none
_CLAIMS = """(select conv_id, turn, p as pos, c as claim from (select conv_id, turn, c, row_number() over (partition by conv_id, turn order by min(i)) - 1 as p from (
  select conv_id, turn, unnest(range(len(l))) as i, unnest(l) as c from (select conv_id, turn, list_filter(list_transform(regexp_extract_all(text, '[^.!?]*[.!?]'), lambda s: trim(s)), lambda s: length(s) >= 20) as l from conversations)) group by conv_id, turn, c) where p < 8)"""


def _claims(spark, d):
    c = table(spark, d, "conversations").withColumn("k", F.struct("conv_id", "turn"))
    return claims.claims(c, "k").select("k.conv_id", "k.turn", "pos", "claim", "claim_id")


@query(f"select conv_id, turn, pos::int as pos, substr(sha256(substr(claim, 1, 200)), 1, 32) as claim_id, not claim like '%?' and (regexp_matches(claim, '[0-9]') or length(claim) >= 60) as verifiable from {_CLAIMS}")
def claim_rows(spark, d):
    return _claims(spark, d).select("conv_id", "turn", "pos", "claim_id", claims.verifiable(F.col("claim")).alias("verifiable"))


@query(f"""select conv_id, len(t)::bigint as tokens, len(list_intersect(t, u))::bigint as shared, len(list_filter(list_intersect(t, u), lambda x: list_contains(['the', 'des', 'les', 'that', 'der', 'die'], x)))::bigint as anchors,
 case when o and f then 'Contradicted' when o and len(t) >= 5 and len(list_intersect(t, u)) >= 6 and len(list_filter(list_intersect(t, u), lambda x: list_contains(['des', 'les', 'die', 'der', 'que'], x))) >= 0 then 'Supported' else 'Unknown' end as stance
from (select a.conv_id, {tokens_sql('a.text')} as t, {tokens_sql('b.text')} as u, a.conv_id % 3 = 0 as o, contains(lower(a.text), 'idiot') as f from conversations a join conversations b on a.conv_id = b.conv_id and a.turn = 0 and b.turn = 1)""".replace("['the', 'des', 'les', 'that', 'der', 'die']", "['des', 'les', 'die', 'der', 'que']"))
def nli_diagnostics(spark, d):
    c = table(spark, d, "conversations")
    j = c.where("turn = 0").select("conv_id", F.col("text").alias("x")).join(c.where("turn = 1").select("conv_id", F.col("text").alias("y")), "conv_id")
    j = j.withColumn("f", claims.diagnostics(F.col("x"), F.col("y"), ["des", "les", "die", "der", "que"], STOP))
    official, wrong = F.col("conv_id") % 3 == 0, F.contains(F.lower("x"), F.lit("idiot"))
    # thresholds on anchors are those of an editable list; here they ask for none
    s = F.when(wrong & official, "Contradicted").when(official & (F.col("f.tokens") >= 5) & (F.col("f.shared") >= 6), "Supported").otherwise("Unknown")
    return j.select("conv_id", "f.tokens", "f.shared", "f.anchors", s.alias("stance"))


@query(f"""select conv_id, arg_max(turn, (share, -turn)) as turn, case when max(share) >= 0.2 then 'overlap' else 'none' end as found from (select a.conv_id, b.turn,
 case when len(list_filter(a.t, lambda x: length(x) >= 5)) = 0 then 0.0 else len(list_intersect(list_filter(a.t, lambda x: length(x) >= 5), list_filter(b.t, lambda x: length(x) >= 5)))::double / len(list_filter(a.t, lambda x: length(x) >= 5)) end as share
 from (select conv_id, {tokens_sql('text')} as t from conversations where turn = 0) a join (select conv_id, turn, {tokens_sql('text')} as t from conversations where turn > 0) b using (conv_id)) group by conv_id""")
def overlap_explain(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", text.tokens(F.col("text"), STOP).alias("t"))
    j = c.where("turn > 0").join(c.where("turn = 0").select("conv_id", F.col("t").alias("own")), "conv_id")
    best = j.groupBy("conv_id").agg(F.max(F.struct(text.overlap_share(F.col("own"), F.col("t")).alias("share"), (-F.col("turn")).alias("m"))).alias("b"))
    return best.select("conv_id", (-F.col("b.m")).alias("turn"), F.when(F.col("b.share") >= 0.2, "overlap").otherwise("none").alias("found"))


@query("""with r as (select p_partkey as k, p_brand as tag from part), c as (select distinct p_brand as tag, p_type as title, p_size > 25 as official from part), m as (select k, official, title from r join c using (tag)),
t as (select *, row_number() over (partition by k, official order by title) as turn from m) select k, official, title, turn::int as turn from t where turn <= case when official then 4 else 8 end""")
def corpus_match_capped(spark, d):
    p = table(spark, d, "part")
    corpus = p.select(F.col("p_brand").alias("tag"), F.col("p_type").alias("title"), (F.col("p_size") > 25).alias("official")).distinct()
    return claims.matched(p.select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("tag")), corpus, "k", "tag", "title", "official")


@query("select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey)::int as by_date, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey)::int as by_price, row_number() over (partition by o_custkey order by case when o_orderstatus = 'P' then null else o_totalprice end desc nulls last, o_orderkey)::int as by_risk from orders")
def order_variants(spark, d):
    w = Window.partitionBy("o_custkey")
    risk = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    turn = lambda *o: F.row_number().over(w.orderBy(*o))
    return table(spark, d, "orders").select("o_orderkey", turn(F.desc("o_orderdate"), "o_orderkey").alias("by_date"), turn("o_totalprice", "o_orderkey").alias("by_price"), turn(risk.desc_nulls_last(), "o_orderkey").alias("by_risk"))


@query(f"with c as (select doc_id, list(distinct category) as c, sum(weight) as w from ({hits_sql('documents', 'doc_id', 'text')}) group by doc_id) select doc_id, list_contains(c, 'en') and list_contains(c, 'romance') as needs_all, w >= 4 as heavy, (list_contains(c, 'en') and list_contains(c, 'romance')) or (list_has_any(c, ['de', 'fr']) and w >= 4) as matched from c")
def spec_match(spark, d):
    h = docs(spark, d).select("doc_id", lexicon.hits(F.col("text"), LEXICON).alias("h")).where(F.size("h") > 0)
    c = F.transform("h", lambda x: x["category"])
    every = F.array_contains(c, "en") & F.array_contains(c, "romance")
    heavy = F.aggregate("h", F.lit(0), lambda a, x: a + x["weight"]) >= 4
    return h.select("doc_id", every.alias("needs_all"), heavy.alias("heavy"), (every | (F.arrays_overlap(c, F.array(F.lit("de"), F.lit("fr"))) & heavy)).alias("matched"))


@query(f"""select doc_id, case when {word_sql('lower(text)', 'the')} and {word_sql('lower(text)', 'of')} then 'ingles' when {word_sql('lower(text)', 'les')} or {word_sql('lower(text)', 'des')} then 'frances' when {word_sql('lower(text)', 'und')} then 'aleman' else 'otra' end as narrative from documents""")
def narrative_classify(spark, d):
    has = lambda w: text.has_word(F.col("text"), w)
    return docs(spark, d).select("doc_id", F.when(has("the") & has("of"), "ingles").when(has("les") | has("des"), "frances").when(has("und"), "aleman").otherwise("otra").alias("narrative"))


@query("""with n as (select source, 'lang:' || lang as tag, count(*)::bigint as n from documents group by 1, 2) select source || '>' || tag as edge, n from n union all select 'all>' || source, sum(n)::bigint from n group by source""")
def compact_graph(spark, d):
    n = docs(spark, d).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    leaves = n.select(F.concat("source", F.lit(">lang:"), "lang").alias("edge"), "n")
    return leaves.unionByName(n.groupBy("source").agg(F.sum("n").alias("n")).select(F.concat(F.lit("all>"), "source").alias("edge"), "n"))


@query("""select source, count(*)::bigint as volume, count(distinct lang)::bigint as langs, max(n_chars) as longest, string_agg(doc_id::varchar, ',' order by n_chars desc, doc_id) filter (where r <= 3) as top from (select *, row_number() over (partition by source order by n_chars desc, doc_id) as r from documents) group by source""")
def dossier(spark, d):
    r = docs(spark, d).select("source", "lang", "n_chars", "doc_id")
    top = facets.top_per_group(r, ["source"], [F.desc("n_chars"), F.col("doc_id")], 3).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("turn", "doc_id"))).alias("t"))
    n = r.groupBy("source").agg(F.count(F.lit(1)).alias("volume"), F.countDistinct("lang").alias("langs"), F.max("n_chars").alias("longest"))
    return n.join(top, "source").select("source", "volume", "langs", "longest", F.array_join(F.transform("t", lambda x: x["doc_id"].cast("string")), ",").alias("top"))


@query("select a.vec_id as query, b.vec_id as match, floor(1000 * list_cosine_similarity(a.embedding::double[], b.embedding::double[]))::bigint as milli from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0 and list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.92")
def semantic_dup_092(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    near = relations.cosine_pairs(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", least=0.92)
    return near.select("query", "match", F.floor(F.col("cosine") * 1000).cast("long").alias("milli"))


@query("""select c_custkey, coalesce(n_name, 'XX') as stored, case when coalesce(n_name, 'XX') = 'FRANCE' or substr(coalesce(n_name, 'XX'), 1, 2) = 'FR' or c_mktsegment = 'FRANCE' then true else false end as matches from customer left join nation on n_nationkey = c_nationkey""")
def filter_country(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"), "left").withColumn("stored", F.coalesce("n_name", F.lit("XX")))
    return c.select("c_custkey", "stored", ((F.col("stored") == "FRANCE") | (F.substring("stored", 1, 2) == "FR") | (F.col("c_mktsegment") == "FRANCE")).alias("matches"))


@query("""select doc_id, case when length(split_part(text, chr(10), 1)) < 20 then true when n_chars < 80 then true else false end as skipped from documents""")
def filter_relevance_gate(spark, d):
    title = F.substring_index("text", "\n", 1)
    return docs(spark, d).select("doc_id", ((F.length(title) < 20) | (F.col("n_chars") < 80)).alias("skipped"))


@query("""select e.conv_id, e.turn, c.role as parent_role, length(c.text)::bigint as parent_length from conversations e left join conversations c on c.conv_id = e.conv_id and c.turn = e.turn - 1""")
def child_left_parent(spark, d):
    c = table(spark, d, "conversations")
    up = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("parent_role"), F.length("text").cast("long").alias("parent_length"))
    return c.select("conv_id", "turn").join(up, ["conv_id", "turn"], "left")


@query(f"select h.term, d.source, count(*)::bigint as n from ({hits_sql('documents', 'doc_id', 'text')}) h join documents d using (doc_id) where h.weight >= 2 group by 1, 2")
def keyword_graph_join(spark, d):
    h = docs(spark, d).select("source", F.explode(lexicon.hits(F.col("text"), LEXICON)).alias("h")).where("h.weight >= 2")
    return h.groupBy(F.col("h.term").alias("term"), "source").agg(F.count(F.lit(1)).alias("n"))


@query("""select 'documents' as part, count(*)::bigint as n, coalesce(sum(n_chars), 0)::bigint as size from documents union all select 'labels', count(*), count(*) filter (where quality = 1) from labels union all select 'events', count(*), count(distinct user_id) from events""")
def stats_bundle(spark, d):
    a = docs(spark, d).agg(F.lit("documents").alias("part"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("size"))
    b = table(spark, d, "labels").agg(F.lit("labels").alias("part"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("size"))
    return a.union(b).union(table(spark, d, "events").agg(F.lit("events").alias("part"), F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("size")))


@query("""select l_orderkey, l_linenumber, printf('%s %d × %.2f', 'Discrepancia', l_linenumber, 0.28) as explain from lineitem""")
def explain_contrib(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.format_string("%s %d × %.2f", F.lit("Discrepancia"), "l_linenumber", F.lit(scoring.WEIGHTS["evidence_contradiction"])).alias("explain"))


@query("""select page_id, case when regexp_matches(trim(url), '^https?://[^/?#]+\\.[^/?#]+') then trim(url) end as safe, case when regexp_matches(lower(url), 'example|localhost') then true else false end as fake from pages""")
def url_sanitise(spark, d):
    return table(spark, d, "pages").select("page_id", urls.public(F.col("url")).alias("safe"), F.lower("url").rlike("example|localhost").alias("fake"))


@query("""select conv_id, turn, regexp_replace(text, '\\s*(Via|Fuente|Source):.*$', '') as cut, 'verify ' || split_part(text, ' ', 1) || ' ' || role as template from conversations""")
def tail_strip_templates(spark, d):
    cut = F.regexp_replace("text", r"\s*(Via|Fuente|Source):.*$", "")
    return table(spark, d, "conversations").select("conv_id", "turn", cut.alias("cut"), F.concat_ws(" ", F.lit("verify"), F.substring_index("text", " ", 1), "role").alias("template"))


@query("""with t as (select doc_id, 0 as tier from documents where n_chars > 15000 union all select doc_id, 1 from documents where lang = 'es' and n_chars > 5000 union all select doc_id, 2 from documents where source = 'src1') select doc_id, min(tier) as tier, doc_id as seq from t group by doc_id order by tier, doc_id limit 24""")
def sample_tiers(spark, d):
    r = docs(spark, d).withColumn("seq", F.col("doc_id"))
    return relations.first_tier([r.where("n_chars > 15000"), r.where("lang = 'es' and n_chars > 5000"), r.where("source = 'src1'")], "doc_id", "seq", 24)


@query("""with m as (select c_custkey as k, c_name as a, c_acctbal as b from customer), n as (select c_custkey as k, upper(c_name) as a, c_acctbal + 1 as b from customer where c_custkey % 5 = 0) select m.k, coalesce(n.a, m.a) as a, m.b from m left join n using (k)""")
def mirror_partial_update(spark, d):
    from marisma.sinks import tables

    m = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("a"), F.col("c_acctbal").alias("b"))
    return tables.upsert(m, m.where("k % 5 = 0").select("k", F.upper("a").alias("a"), (F.col("b") + 1).alias("b")), ["k"], ["a"])


@query("select user_id, event_type, min(event_id) as event_id from events group by 1, 2")
def stream_dedup_first(spark, d):
    src = table(spark, d, "events")
    rows = spark.readStream.schema(src.schema).parquet(f"{d}/events.parque[t]").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    return batches.run_to_files(rows, ["user_id", "event_type"], "stream-first")


@query("""with g as (select user_id, ts, case when date_diff('microsecond', lag(ts) over (partition by user_id order by ts), ts) >= 21600000000 or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as s from events), i as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, min(ts) as since, count(*)::bigint as n from i group by user_id, k""")
def session_windows(spark, d):
    e = table(spark, d, "events").select("user_id", "ts").withColumn("at", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("at", "6 hours").alias("w")).agg(F.min("ts").alias("since"), F.count(F.lit(1)).alias("n")).select("user_id", "since", "n")


@query("""select doc_id, sha256(text) as h, case when length(text) >= 500 then 'full' else 'short' end as kind from documents""")
def worker_composition(spark, d):
    return docs(spark, d).select("doc_id", hashing.sha(F.col("text")).alias("h"), F.when(F.length("text") >= 500, "full").otherwise("short").alias("kind"))
