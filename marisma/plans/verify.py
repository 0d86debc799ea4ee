"""Evidence, stance, votes, risk and review queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marisma.functions import hashing, scoring, text
from marisma.operators import facets
from marisma.plans.kit import STOP, docs, tokens_sql
from marisma.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# signals of each line item, made from its numbers
_PARTS_SQL = "(l_quantity * 2)::double as evidence_contradiction, ((l_linenumber * 17) % 130)::double as source_reliability, (case when l_returnflag = 'R' then 78 else 0 end)::double as image_reuse, (case when l_linestatus = 'O' then 80 else 15 end)::double as claim_severity, (l_discount * 1000)::double as narrative_growth, (l_tax * 1000)::double as visual_anomaly"
_CLIP = "greatest(0.0::double, least(100.0::double, {}))"
_SCORE = "round_even(0.0::double + " + " + ".join(f"{_CLIP.format(k)} * {w}::double" for k, w in scoring.WEIGHTS.items()) + ", 0)::bigint"
_RISK = f"(select l_orderkey, l_linenumber, case when l_linenumber = 1 then 'Contradicted' when l_linenumber <= 3 then 'Supported' else 'Unknown' end as nli, l_quantity >= 49 as human, l_linenumber = 7 as low, {_SCORE} as score from (select *, {_PARTS_SQL} from lineitem))"
_VERDICT = "case when human or low then 'REVISIÓN HUMANA' when nli = 'Contradicted' or score >= 75 then 'CONTRADICHO' when nli = 'Supported' and score < 35 then 'RESPALDADO' when score >= 55 then 'POSIBLEMENTE ENGAÑOSO' when nli = 'Supported' then 'RESPALDADO' else 'INSUFICIENTE' end"


def _risk(spark, d):
    x = table(spark, d, "lineitem")
    parts = {
        "evidence_contradiction": (F.col("l_quantity") * 2).cast("double"), "source_reliability": ((F.col("l_linenumber") * 17) % 130).cast("double"), "image_reuse": F.when(F.col("l_returnflag") == "R", 78.0).otherwise(0.0),
        "claim_severity": F.when(F.col("l_linestatus") == "O", 80.0).otherwise(15.0), "narrative_growth": (F.col("l_discount") * 1000).cast("double"), "visual_anomaly": (F.col("l_tax") * 1000).cast("double"),
    }
    nli = F.when(F.col("l_linenumber") == 1, "Contradicted").when(F.col("l_linenumber") <= 3, "Supported").otherwise("Unknown")
    return x.select("l_orderkey", "l_linenumber", nli.alias("nli"), (F.col("l_quantity") >= 49).alias("human"), (F.col("l_linenumber") == 7).alias("low"), scoring.weighted_risk(parts).alias("score"))


@query(f"select l_orderkey, l_linenumber, score from {_RISK}")
def risk_score_weighted(spark, d):
    return _risk(spark, d).select("l_orderkey", "l_linenumber", "score")


@query(f"select verdict, rule, count(*)::bigint as n, (count(*) filter (where score >= 55 or verdict in ('CONTRADICHO', 'POSIBLEMENTE ENGAÑOSO', 'REVISIÓN HUMANA')))::bigint as alerts from (select *, case when verdict = 'REVISIÓN HUMANA' then case when score % 2 = 1 then 'cifra_parte' when human then 'discrepancia' when low then 'baja_confianza' else 'human' end when nli = 'Contradicted' then 'nli_contradicted' when score >= 75 then 'score_high' when verdict = 'RESPALDADO' then 'supported_low_risk' when verdict = 'POSIBLEMENTE ENGAÑOSO' then 'score_mid' else 'insufficient_evidence' end as rule from (select *, {_VERDICT} as verdict from {_RISK})) group by verdict, rule")
def risk_verdict(spark, d):
    r = _risk(spark, d)
    s, nli, human, low = (F.col(c) for c in ("score", "nli", "human", "low"))
    numeric, cut = F.when(s % 2 == 1, 86).otherwise(0), F.when(human, 88).otherwise(0)
    r = r.select("score", scoring.verdict(s, nli, human, low).alias("verdict"), scoring.rule(s, nli, human, low, cut, numeric).alias("rule"))
    return r.groupBy("verdict", "rule").agg(F.count(F.lit(1)).alias("n"), F.count_if(scoring.needs_alert(F.col("score"), F.col("verdict"))).alias("alerts"))


@query("""select l_orderkey, (count(*) filter (where l_returnflag = 'R'))::bigint as contradicted, (count(*) filter (where l_returnflag = 'A'))::bigint as supported, count(*)::bigint as n,
 case when c > s and c >= 1 then 'Contradicted' when s > c and s >= 2 then 'Supported' when s >= 1 and c = 0 then 'Supported' else 'Unknown' end as label,
 case when c > s and c >= 1 then round(least(0.95::double, c * 0.15::double + 0.5::double), 3) when s > c and s >= 2 then round(least(0.9::double, s * 0.12::double + 0.45::double), 3) when s >= 1 and c = 0 then 0.62 else 0.35 end::double as confidence
from (select *, count(*) filter (where l_returnflag = 'R') over (partition by l_orderkey) as c, count(*) filter (where l_returnflag = 'A') over (partition by l_orderkey) as s from lineitem) group by l_orderkey, c, s""")
def nli_vote_confidence(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("contradicted"), F.count_if(F.col("l_returnflag") == "A").alias("supported"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("v", scoring.vote(F.col("supported"), F.col("contradicted"), F.col("n"))).select("l_orderkey", "contradicted", "supported", "n", "v.label", "v.confidence")


@query(f"""with c as (select conv_id, turn, {tokens_sql('text')} as t from conversations where role = 'user'), e as (select conv_id, turn, {tokens_sql('text')} as t from conversations where role <> 'user'),
p as (select c.conv_id, c.turn, e.turn as other, len(c.t) as n, len(list_intersect(c.t, e.t)) as o from c join e using (conv_id))
select conv_id, turn, other::bigint as other, o::bigint as shared, case when n < 5 or o < 6 then 'Unknown' else 'Supported' end as stance from p""")
def evidence_pair_stance(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", text.tokens(F.col("text"), STOP).alias("t"))
    a = c.where("role = 'user'").select("conv_id", "turn", F.col("t").alias("x"))
    b = c.where("role <> 'user'").select("conv_id", F.col("turn").cast("long").alias("other"), F.col("t").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return a.join(b, "conv_id").select("conv_id", "turn", "other", shared.cast("long").alias("shared"), F.when((F.size("x") < 5) | (shared < 6), "Unknown").otherwise("Supported").alias("stance"))


@query("""select o_orderkey, (o_orderkey % 400)::bigint as a, (o_custkey % 90)::bigint as b, case when ratio >= 5 and gap >= 20 then 86 when ratio >= 2 and gap >= 10 then 62 else 0 end as score from (
 select *, abs(o_orderkey % 400 - o_custkey % 90) as gap, greatest(o_orderkey % 400, o_custkey % 90)::double / greatest(least(o_orderkey % 400, o_custkey % 90), 1) as ratio from orders)""")
def numeric_discrepancy(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 400).alias("a"), (F.col("o_custkey") % 90).alias("b"))
    return o.withColumn("score", scoring.numeric_discrepancy(F.col("a"), F.col("b")))


@query("""select o_custkey, case when ok > 0 and bad > 0 then 88 when ok > 0 and n > 3 then 58 when back > 0 and bad > 0 then 72 else 0 end as score from (
 select o_custkey, count(*) as n, count(*) filter (where o_orderstatus = 'F' and o_orderpriority = '1-URGENT') as ok, count(*) filter (where o_orderstatus = 'F') as back, count(*) filter (where o_orderstatus = 'P') as bad from orders group by o_custkey)""")
def cross_cut(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")).alias("ok"), F.count_if(F.col("o_orderstatus") == "F").alias("back"), F.count_if(F.col("o_orderstatus") == "P").alias("bad")
    )
    score = F.when((F.col("ok") > 0) & (F.col("bad") > 0), 88).when((F.col("ok") > 0) & (F.col("n") > 3), 58).when((F.col("back") > 0) & (F.col("bad") > 0), 72).otherwise(0)
    return g.select("o_custkey", score.alias("score"))


@query("""select source, least(40, greatest(-40, sum(case when quality = 1 then -8 else 10 end)))::bigint as shift, count(*)::bigint as n from documents join labels using (doc_id) group by source""")
def hitl_shift(spark, d):
    j = docs(spark, d).select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    total = F.sum(F.when(F.col("quality") == 1, -8).otherwise(10))
    return j.groupBy("source").agg(F.least(F.lit(40).cast("long"), F.greatest(F.lit(-40).cast("long"), total)).alias("shift"), F.count(F.lit(1)).alias("n"))


@query("""select source, case when low > high then 'C' when high > 0 then 'S' else 'U' end as label from (select source, count(*) filter (where quality = 0) * 8 as low, count(*) filter (where quality = 1) as high from documents left join labels using (doc_id) group by source)""")
def majority_label(spark, d):
    g = docs(spark, d).select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left").groupBy("source").agg((F.count_if(F.col("quality") == 0) * 8).alias("low"), F.count_if(F.col("quality") == 1).alias("high"))
    return g.select("source", F.when(F.col("low") > F.col("high"), "C").when(F.col("high") > 0, "S").otherwise("U").alias("label"))


@query("""select doc_id, case quality when 1 then 'RESPALDADO' else 'CONTRADICHO' end as verdict, case quality when 1 then 22 else 82 end as risk, 'RV-' || substr(sha256(doc_id::varchar || ':' || quality::varchar), 1, 12) as review_id from labels""")
def hitl_apply(spark, d):
    label = F.when(F.col("quality") == 1, "validado").otherwise("descartado")
    return table(spark, d, "labels").select(
        "doc_id", scoring.cases(label, {k: v[0] for k, v in scoring.REVIEWED.items()}, "").alias("verdict"), scoring.cases(label, {k: v[1] for k, v in scoring.REVIEWED.items()}, 0).alias("risk"), hashing.short_id("RV-", 12, F.col("doc_id").cast("string"), F.col("quality").cast("string")).alias("review_id")
    )


@query("select quality, (count(*) filter (where toxic = 0))::bigint as clean, (count(*) filter (where toxic = 1))::bigint as toxic, round((count(*) filter (where toxic = 0)) * 100.0::double / count(*), 4) as accuracy from labels group by quality")
def confusion_matrix(spark, d):
    clean = F.count_if(F.col("toxic") == 0)
    return table(spark, d, "labels").groupBy("quality").agg(clean.alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.round(clean * 100.0 / F.count(F.lit(1)), 4).alias("accuracy"))


@query("""select conv_id, max(case when text like '%?%' then 80 when text like '%!%' then 45 when length(text) < 40 then 35 else 15 end) as severity from conversations group by conv_id""")
def severity_max(spark, d):
    s = F.when(F.contains("text", F.lit("?")), 80).when(F.contains("text", F.lit("!")), 45).when(F.length("text") < 40, 35).otherwise(15)
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max(s).alias("severity"))


@query("""select user_id, max(greatest(0.0::double, least(100.0::double, base * greatest(0.45::double, least(1.0::double, case when conf > 1 then conf / 100.0::double else conf end))))) as visual, bool_or(event_type = 'purchase') as reused from (
 select user_id, event_type, (case event_type when 'click' then 92 when 'view' then 8 else 0 end)::double as base, value::double as conf from events) group by user_id""")
def visual_max(spark, d):
    kind = scoring.cases(F.col("event_type"), {"click": "POTENTIALLY_MANIPULATED", "view": "PHOTOGRAPH"}, "none")
    return table(spark, d, "events").groupBy("user_id").agg(F.max(scoring.visual_score(kind, F.col("value").cast("double"))).alias("visual"), F.bool_or(F.col("event_type") == "purchase").alias("reused"))


@query("""select source, n, q, case when q >= 70 then 'alta' when q >= 45 then 'media' else 'baja' end as band from (select source, count(*)::bigint as n,
 18 * (count(*) >= 3)::int + 18 * (max(n_chars) >= 5000)::int + 18 * (count(distinct lang) >= 3)::int + 16 * (min(n_chars) >= 100)::int + 12 * bool_or(lang = 'es')::int + 18 * bool_or(lang = 'de')::int as q from documents group by source)""")
def quality_rubric(spark, d):
    point = lambda c, p: F.when(c, p).otherwise(0)
    q = point(F.count(F.lit(1)) >= 3, 18) + point(F.max("n_chars") >= 5000, 18) + point(F.countDistinct("lang") >= 3, 18) + point(F.min("n_chars") >= 100, 16) + point(F.bool_or(F.col("lang") == "es"), 12) + point(F.bool_or(F.col("lang") == "de"), 18)
    g = docs(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), q.alias("q"))
    return g.withColumn("band", F.when(F.col("q") >= 70, "alta").when(F.col("q") >= 45, "media").otherwise("baja"))


@query("""select s_suppkey, case when s_acctbal < 0 then 'F' when s_nationkey in (1, 2) then 'A' when s_suppkey % 3 = 0 then 'B' else '' end as authority,
 least(100.0, greatest(0.0, case when s_acctbal < 0 then 90 when s_nationkey in (1, 2) then 10 when s_suppkey % 3 = 0 then 25 else 55 end + s_suppkey % 40 - 20))::double as unreliability from supplier""")
def authority_case(spark, d):
    a = F.when(F.col("s_acctbal") < 0, "F").when(F.col("s_nationkey").isin(1, 2), "A").when(F.col("s_suppkey") % 3 == 0, "B").otherwise("")
    s = table(spark, d, "supplier").withColumn("authority", a)
    return s.select("s_suppkey", "authority", scoring.clip(scoring.cases(F.col("authority"), scoring.AUTHORITY, 55) + F.col("s_suppkey") % 40 - 20).alias("unreliability"))


@query("""select c_custkey, growth, case when growth <= 0 then 0.0 else greatest(0.0::double, least(100.0::double, growth * 0.65::double + 18.0::double)) end as score from (select c_custkey, (c_acctbal / 50)::double as growth from customer)""")
def growth_scores(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 50).cast("double").alias("growth"))
    return c.withColumn("score", scoring.growth_score(F.col("growth")))


@query("""select doc_id, quality is null or n_chars < 200 or lang is null as needs from documents left join labels using (doc_id)""")
def needs_enrich_flag(spark, d):
    j = docs(spark, d).select("doc_id", "n_chars", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return j.select("doc_id", (F.col("quality").isNull() | (F.col("n_chars") < 200) | F.col("lang").isNull()).alias("needs"))


@query("""with s as (select doc_id, sha256(text) as h, n_chars, quality from documents left join labels using (doc_id)), f as (select h, min(doc_id) as first from s where quality = 1 and n_chars >= 500 group by h)
select first as doc_id, 'CNN-' || substr(h, 1, 16) as sample_id from f""")
def sample_export_gate(spark, d):
    rows = docs(spark, d).select("doc_id", hashing.sha(F.col("text")).alias("h"), "n_chars").join(table(spark, d, "labels"), "doc_id").where("quality = 1 and n_chars >= 500")
    return rows.groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.concat(F.lit("CNN-"), F.substring("h", 1, 16)).alias("sample_id"))


@query("""select conv_id, turn, shared, place::int as place from (select *, row_number() over (partition by conv_id order by shared desc, turn) as place from (
 select a.conv_id, b.turn, len(list_intersect(a.t, b.t))::bigint as shared from (select conv_id, TOK as t from conversations where turn = 0) a join (select conv_id, turn, TOK as t from conversations where turn > 0) b using (conv_id))) where place <= 4""".replace("TOK", tokens_sql("text")))
def evidence_retrieve_rank(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", text.tokens(F.col("text"), STOP).alias("t"))
    a = c.where("turn = 0").select("conv_id", F.col("t").alias("x"))
    r = c.where("turn > 0").join(a, "conv_id").select("conv_id", "turn", F.size(F.array_intersect("x", "t")).cast("long").alias("shared"))
    top = facets.top_per_group(r.withColumnRenamed("turn", "at"), ["conv_id"], [F.desc("shared"), F.col("at")], 4)
    return top.select("conv_id", F.col("at").alias("turn"), "shared", F.col("turn").alias("place"))
