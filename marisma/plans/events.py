"""Series, facets, windows and pages over events, orders and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marisma.functions import dates, scoring
from marisma.operators import facets, filters, narratives
from marisma.plans.kit import docs
from marisma.sources.feeds import history_windows as windows
from marisma.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark, d):
    return table(spark, d, "events").withColumn("day", F.to_date("ts"))


_DAYS = "(select unnest(generate_series(min(ts)::date::timestamp, max(ts)::date::timestamp, interval 1 day))::date as day from events)"


@query(f"select day, coalesce(n, 0)::bigint as n, n is null as missing, mean_value from {_DAYS} left join (select ts::date as day, count(*) as n, round(avg(value), 1) as mean_value from events group by 1) using (day)")
def daily_dense_series(spark, d):
    return facets.dense_daily(_events(spark, d), "day", {"mean_value": F.round(F.avg("value"), 1)})


@query(f"select day, " + ", ".join(f"(count(*) filter (where event_type = '{t}'))::bigint as {t}" for t in ("click", "view", "purchase")) + " from (select ts::date as day, event_type from events) group by day")
def daily_pivot_by_type(spark, d):
    return _events(spark, d).groupBy("day").agg(*[F.count_if(F.col("event_type") == t).alias(t) for t in ("click", "view", "purchase")])


@query("select list(n order by day) as counts from (select ts::date as day, count(*)::bigint as n from events group by 1 order by day desc limit 14)")
def sparkline_last14(spark, d):
    return facets.last_counts(_events(spark, d).groupBy("day").agg(F.count(F.lit(1)).alias("n")), "day", "n", 14)


@query("select greatest(min(o_orderdate)::date, max(o_orderdate)::date - 90)::date as first_day, max(o_orderdate)::date as last_day from orders")
def default_window_90d(spark, d):
    return facets.chart_window(table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate")), "day")


@query("select week, n, round(n * 100.0::double / sum(n) over (), 4) as percent, n * 100.0::double / sum(n) over () >= 45 as dominant from (select date_trunc('week', ts)::date as week, count(*)::bigint as n from events group by 1)")
def week_dominant_share(spark, d):
    n = _events(spark, d).groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.count(F.lit(1)).alias("n"))
    return facets.share_of_total(n, "n").withColumn("dominant", F.col("percent") >= 45)


@query("select date_trunc('month', o_orderdate)::date as month, count(*)::bigint as n from orders group by 1")
def month_bucket(spark, d):
    return table(spark, d, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg(F.count(F.lit(1)).alias("n"))


_BUCKET = "case when s is null then 'sin_riesgo' when s <= 20 then '0-20' when s <= 40 then '21-40' when s <= 60 then '41-60' when s <= 80 then '61-80' else '81-100' end"
_BUCKETS = ("0-20", "21-40", "41-60", "61-80", "81-100", "sin_riesgo")


@query("select pos, bucket, coalesce(n, 0)::bigint as n from (values " + ", ".join(f"({i}, '{b}')" for i, b in enumerate(_BUCKETS)) + f") as w(pos, bucket) left join (select {_BUCKET} as bucket, count(*) as n from (select case when doc_id % 7 = 0 then null else n_chars % 101 end as s from documents) group by 1) using (bucket)")
def score_histogram_null_bucket(spark, d):
    s = docs(spark, d).select(facets.buckets(F.when(F.col("doc_id") % 7 != 0, F.col("n_chars") % 101)).alias("bucket"))
    return facets.zero_filled(s, "bucket", spark.createDataFrame(list(enumerate(_BUCKETS)), "pos int, bucket string"))


@query("""select count(*)::bigint as total, (count(*) filter (where length(text) < 500 or text is null))::bigint as no_body, (count(*) filter (where source = 'src0'))::bigint as main,
 round_even((count(*) filter (where length(text) < 500 or text is null)) * 100.0::double / count(*), 0)::bigint as no_body_percent, round_even((count(*) filter (where source = 'src0')) * 100.0::double / count(*), 0)::bigint as main_percent from documents""")
def capture_quality(spark, d):
    return facets.quality(docs(spark, d), "src0")


@query("select source, count(*)::bigint as n, max(n_chars) as longest from documents group by source")
def facet_by_source(spark, d):
    return docs(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("longest"))


@query("select pos, lang, coalesce(n, 0)::bigint as n from (values (0, 'en'), (1, 'fr'), (2, 'de'), (3, 'es'), (4, 'it')) as w(pos, lang) left join (select lang, count(*) as n from documents group by lang) using (lang)")
def facet_zero_filled(spark, d):
    return facets.zero_filled(docs(spark, d), "lang", spark.createDataFrame([(0, "en"), (1, "fr"), (2, "de"), (3, "es"), (4, "it")], "pos int, lang string"))


_ARTICLES = "(select doc_id, lang, source, substr(text, 1, 30) as title, text, case when doc_id % 5 = 0 then 'Supported' when doc_id % 5 = 1 then 'CONTRADICHO' else 'Unknown' end as verdict, 'prensa' as origin, case when doc_id % 7 = 0 then null else (n_chars % 101)::double end as risk, date '2024-01-01' + (doc_id % 60)::int as day from documents)"


def _articles(spark, d):
    v = F.when(F.col("doc_id") % 5 == 0, "Supported").when(F.col("doc_id") % 5 == 1, "CONTRADICHO").otherwise("Unknown")
    risk = F.when(F.col("doc_id") % 7 != 0, (F.col("n_chars") % 101).cast("double"))
    return docs(spark, d).select("doc_id", "lang", "source", F.substring("text", 1, 30).alias("title"), "text", v.alias("verdict"), F.lit("prensa").alias("origin"), risk.alias("risk"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")).alias("day"))


@query(f"select doc_id, risk, day from {_ARTICLES} where lang = 'en' and contains(lower(title || ' ' || text || ' ' || source), 'tion') and risk >= 20 and risk <= 90 and day >= date '2024-01-10' order by day desc, doc_id limit 10 offset 10")
def filter_conjunction_page(spark, d):
    q = filters.ArticleQuery.parse(lang="en", text=" tion ", min_risk=20, max_risk=90, since="2024-01-10", page="2", size=10)
    return filters.page(_articles(spark, d).where(q.condition()), [F.desc("day"), F.col("doc_id")], q.page, q.size).select("doc_id", "risk", "day")


@query(f"select count(*)::bigint as total from {_ARTICLES} where risk is null and (contains(lower(verdict), 'respaldado') or contains('respaldado', lower(verdict)) or contains(lower(verdict), 'respald') or contains(lower(verdict), 'supported'))")
def filter_alias_total(spark, d):
    q = filters.ArticleQuery.parse(verdict="respaldado", risk_null="true", min_risk=50)
    return _articles(spark, d).where(q.condition()).agg(F.count(F.lit(1)).alias("total"))


@query(f"select doc_id, risk, day from {_ARTICLES} order by risk desc nulls last, day, doc_id limit 40")
def risk_order_nulls(spark, d):
    return filters.page(_articles(spark, d), [F.desc_nulls_last("risk"), F.col("day"), F.col("doc_id")], 1, 40).select("doc_id", "risk", "day")


@query(f"""select doc_id, case when contains(lower(verdict), 'respald') or lower(verdict) = 'supported' then 'respaldado' when contains(lower(verdict), 'insufic') then 'insuficiente' when contains(lower(verdict), 'contrad') then 'contradicho' else 'sin_verificar' end as k,
 contains(lower(verdict), 'contrad') as contradicted, contains(lower(verdict), 'unknown') or verdict in ('', 'sin verificar') as unknown from {_ARTICLES}""")
def verdict_stance_case(spark, d):
    return _articles(spark, d).select("doc_id", filters.verdict_key(F.col("verdict")).alias("k"), filters.stance_matches(F.col("verdict"), "contradicted").alias("contradicted"), filters.stance_matches(F.col("verdict"), "sin verificar").alias("unknown"))


_DAILY = "(select event_type, ts::date as day, count(*)::bigint as n from events group by 1, 2)"


def _daily(spark, d):
    return _events(spark, d).groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("n"))


@query(f"""select event_type, days, case when days < 4 then 100.0 else round((second - first) * 100.0::double / greatest(first, 1), 1) end as growth from (
 select event_type, count(*)::bigint as days, sum(n) filter (where i <= c // 2) as first, sum(n) filter (where i > c // 2) as second from (select *, row_number() over (partition by event_type order by day) as i, count(*) over (partition by event_type) as c from {_DAILY}) group by event_type)""")
def half_split_growth(spark, d):
    return narratives.half_growth(_daily(spark, d), "event_type", "day", "n")


@query(f"""with r as (select *, row_number() over (partition by event_type order by day) - 1 as i, lag(n) over (partition by event_type order by day) as b from {_DAILY}),
e as (select event_type, arg_max(i, (n, -i)) as peak, max(n) as top, min(i) filter (where n > 0) as first, max(i) filter (where n > 0) as last, arg_min(n, i) as s, arg_max(n, i) as t, arg_max(day, (n, -i)) as peak_day from r group by event_type),
a as (select event_type, bool_or(i >= peak + 2 and n > b) as again from r join e using (event_type) group by event_type)
select event_type, peak_day, case when peak < last and t < top and again then 'recurrencia' when peak < last and t < top then 'descenso' when peak = last and t > s then 'crecimiento' when peak = last then 'pico' when last - first >= 3 then 'propagacion' else 'aparicion' end as stage from e join a using (event_type)""")
def lifecycle_stage(spark, d):
    return narratives.lifecycle(_daily(spark, d), "event_type", "day", "n")


@query("""with r as (select event_type, ts, row_number() over (partition by event_type order by ts, event_id) - 1 as i, count(*) over (partition by event_type) as n from events)
select event_type, least(i // (n // least(n, 5)), least(n, 5) - 1)::bigint + 1 as chunk, count(*)::bigint as n, min(ts) as since, max(ts) as until from r group by 1, 2""")
def semantic_chunks(spark, d):
    rows = narratives.time_chunks(table(spark, d, "events").select("event_type", "event_id", "ts"), "event_type", "ts", "event_id")
    return rows.groupBy("event_type", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("since"), F.max("ts").alias("until"))


@query("""select user_id, n, days, case when n = 0 then 0 when judged = 0 and official = 0 then 1 when official >= 1 and n < 3 then 2 else 3 end as base,
 case when official >= 2 and days >= 5 and n >= 5 then 5 when n = 0 then 0 when judged = 0 and official = 0 then 1 when official >= 1 and n < 3 then 2 else 3 end as level,
 case when n >= 25 and days * 10 >= 150 and official >= 2 and judged > 0 then 'critica' when n >= 15 and days * 10 >= 80 then 'alta' when n >= 8 and (days * 10 >= 40 or judged > 0) then 'media' else 'baja' end as priority from (
 select user_id, count(*)::bigint as n, (count(*) filter (where event_type = 'purchase'))::bigint as official, (count(*) filter (where event_type = 'click'))::bigint as judged, count(distinct ts::date)::bigint as days from events group by user_id)""")
def contrast_priority(spark, d):
    r = _events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "purchase").alias("official"), F.count_if(F.col("event_type") == "click").alias("judged"), F.countDistinct("day").alias("days"))
    level = scoring.contrast_level(F.col("n"), F.col("official"), F.col("judged"), F.col("days"))
    base = scoring.contrast_level(F.col("n"), F.col("official"), F.col("judged"), F.lit(0))
    p = scoring.priority(F.col("n"), F.col("days") * 10, F.col("official"), F.col("judged") > 0, F.lit(True))
    return r.select("user_id", "n", "days", base.alias("base"), level.alias("level"), p.alias("priority"))


@query("""select event_type, greatest(0, date_diff('second', max(ts), timestamp '2024-01-31 00:00:00'))::bigint as lag, greatest(0, date_diff('second', max(ts), timestamp '2024-01-31 00:00:00')) >= 300 as stale from events group by event_type""")
def lag_seconds(spark, d):
    lag = dates.lag_seconds(F.date_trunc("second", F.max("ts")), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))
    return table(spark, d, "events").groupBy("event_type").agg(lag.alias("lag")).withColumn("stale", F.col("lag") >= 300)


@query("""select i, (timestamp '2024-03-01' - interval 3 day - i * interval 24 hour - interval 24 hour) as since, (timestamp '2024-03-01' - interval 3 day - i * interval 24 hour) as until from range(30) t(i) where timestamp '2024-03-01' - interval 3 day - i * interval 24 hour - interval 24 hour >= timestamp '2024-03-01' - interval 10 day""")
def history_windows(spark, d):
    w = windows(spark, "2024-03-01 00:00:00", 3, 10, 30)
    return w.select("i", F.col("since").cast("timestamp_ntz").alias("since"), F.col("until").cast("timestamp_ntz").alias("until"))


_RAW = [("20240105T101500Z",), ("2024-01-05T10:15:00Z",), ("2024-01-05T10:15:00+02:00",), ("Fri, 05 Jan 2024 10:15:00 GMT",), ("Mon, 5 Jan 2024 10:15:00 -0600",), ("2024-01-05",), ("nonsense",), ("",), (None,)]


@query("""select * from (values ('20240105T101500Z', timestamp '2024-01-05 00:00:00'), ('2024-01-05T10:15:00Z', timestamp '2024-01-05 10:15:00'), ('2024-01-05T10:15:00+02:00', timestamp '2024-01-05 08:15:00'), ('Fri, 05 Jan 2024 10:15:00 GMT', timestamp '2024-01-05 10:15:00'),
 ('Mon, 5 Jan 2024 10:15:00 -0600', timestamp '2024-01-05 16:15:00'), ('2024-01-05', timestamp '2024-01-05 00:00:00'), ('nonsense', null), ('', null), (null, null)) as t(raw, parsed)""")
def date_layouts(spark, d):
    return spark.createDataFrame(_RAW, "raw string").select("raw", dates.parse_datetime(F.col("raw")).cast("timestamp_ntz").alias("parsed"))


@query("""with s as (select s_suppkey, s_name, (s_suppkey % 5)::int as failures, timestamp '2024-01-01' + s_suppkey * interval 1 minute as last_checked, [15, 30, 60, 360, 720][(s_suppkey % 5)::int + 1] as freq from supplier)
select s_suppkey, last_checked + freq * interval 1 minute <= timestamp '2024-01-01 02:00:00' as due, case failures when 0 then 0 when 1 then 30 when 2 then 120 else 21600 end as backoff, case when failures >= 3 then 'error' when failures > 0 then 'deferred' else 'ok' end as status from s""")
def due_sources(spark, d):
    s = table(spark, d, "supplier").withColumn("f", (F.col("s_suppkey") % 5).cast("int"))
    checked = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("s_suppkey").cast("int"))
    freq = F.element_at(F.array(*[F.lit(x) for x in (15, 30, 60, 360, 720)]), F.col("f") + 1)
    return s.select("s_suppkey", (checked + F.make_dt_interval(mins=freq) <= F.lit("2024-01-01 02:00:00").cast("timestamp_ntz")).alias("due"), scoring.cases(F.col("f"), {0: 0, 1: 30, 2: 120}, 21600).alias("backoff"), F.when(F.col("f") >= 3, "error").when(F.col("f") > 0, "deferred").otherwise("ok").alias("status"))


@query("""with e as (select user_id, ts, event_id, event_type = 'click' as failed from events), g as (select *, sum((not failed)::int) over (partition by user_id order by ts, event_id) as island from e)
select user_id, max(run)::bigint as longest from (select user_id, island, count(*) filter (where failed) as run from g group by 1, 2) group by user_id""")
def failure_counter(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "click").alias("failed"))
    g = e.withColumn("island", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(w))
    return g.groupBy("user_id", "island").agg(F.count_if("failed").alias("run")).groupBy("user_id").agg(F.max("run").alias("longest"))


@query(f"select event_type, day, n, coalesce(lag(n) over (partition by event_type order by day), 0)::bigint as before from {_DAILY}")
def prev_snapshot(spark, d):
    before = F.lag("n").over(Window.partitionBy("event_type").orderBy("day"))
    return _daily(spark, d).select("event_type", "day", "n", F.coalesce(before, F.lit(0)).alias("before"))


@query("select event_id, coalesce(json_extract_string(props, '$.k'), '') as ref, json_extract_string(props, '$.absent') is null as absent from events")
def json_extract_default(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("ref"), F.get_json_object("props", "$.absent").isNull().alias("absent"))


@query("select count(*)::bigint as total, count(distinct user_id)::bigint as users, (count(*) filter (where value > 50))::bigint as high, min(ts) as first, max(ts) as last from events")
def kpi_counts(spark, d):
    return table(spark, d, "events").agg(F.count(F.lit(1)).alias("total"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("value") > 50).alias("high"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("select least(3600, greatest(15, date_diff('second', timestamp '2024-01-01', min(ts) + interval 30 minute)))::bigint as seconds from events")
def next_wakeup(spark, d):
    at = F.unix_timestamp((F.date_trunc("second", F.min("ts")) + F.expr("interval 30 minutes")).cast("timestamp")) - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return table(spark, d, "events").agg(F.least(F.lit(3600).cast("long"), F.greatest(F.lit(15).cast("long"), at)).alias("seconds"))


@query("select lang, source, n, row_number() over (order by n desc, lang, source)::int as place from (select lang, source, count(*)::bigint as n from documents group by 1, 2) order by n desc, lang, source limit 12")
def most_common(spark, d):
    n = docs(spark, d).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    top = n.orderBy(F.desc("n"), "lang", "source").limit(12)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "lang", "source")))


@query("select date_trunc('hour', ts) as since, event_type, count(*)::bigint as n from events group by 1, 2")
def stream_tumbling(spark, d):
    from marisma.streaming import batches

    src = table(spark, d, "events")
    rows = batches.tumbling_counts(spark.readStream.schema(src.schema).parquet(f"{d}/events.parque[t]"), "ts", "1 hour", "40 days", "event_type")
    out = batches.run_to_files(rows.select("window.start", "window.end", "event_type", "n"), ["start", "end", "event_type"], "tumbling")
    return out.select(F.col("start").cast("timestamp_ntz").alias("since"), "event_type", "n")
