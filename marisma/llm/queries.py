"""Registered queries of the subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marisma.llm import bpe_tree, decontam, exact_dedup, jaccard_join, language_id, line_dedup, lm_score, periodic_runs, prefix_trie, quality_cnn, simhash, url_filter, wavelet
from marisma.llm.scratch import place


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(_documents(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_id.predict_languages(_documents(spark, sf_dir))
    return out.select("doc_id", (language_id.fold(5) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op4_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_tree.encode_documents(_documents(spark, sf_dir))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_documents(spark, sf_dir), size=3, percent=90)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_stream(spark, f"{sf_dir}/documents.parquet")


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontam.find_leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return leaks.select("doc_id", "item_id", "cosine", "lcs_share", "answer_share")


def op8_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_cnn.score_quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", (language_id.fold(3) == 1).alias("held_out"), "score", "predicted")


def op9_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = place(spark, "wavelet")
    wavelet.write_shards(_documents(spark, sf_dir), at)
    return wavelet.read_documents(spark, at).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    trie = prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), c - c % 100, F.crc32(c.cast("string")) % 6)
    out = trie.nodes.join(prefix_trie.ends_digests(trie.ends), prefix_trie.NODE, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def _with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the texts, told by their doc_id, repeat a few of their words from some word to the end."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = docs.select("doc_id", "text", words.alias("words")).withColumns({"n": F.size("words").cast("long"), "g": F.floor(h / 10), "chosen": h % 10 == 0})
    a, i = F.col("g") % F.col("n"), F.sequence(F.lit(0).cast("long"), F.col("n") - 1)
    docs = docs.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    source = lambda k: F.when(k >= F.col("a"), F.col("a") + (k - F.col("a")) % F.col("p")).otherwise(k)
    # the one-element array binds the words once for all places
    repeated = F.transform(F.array("words"), lambda w: F.array_join(F.transform(i, lambda k: F.element_at(w, (source(k) + 1).cast("int"))), " "))[0]
    return docs.select("doc_id", F.when(F.col("chosen") & (F.col("n") > 0), repeated).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.collapse_runs(_with_repeats(_documents(spark, sf_dir)))
    longest = F.array_sort("runs", lambda a, b: F.when(a["length"] != b["length"], F.signum(b["length"] - a["length"]).cast("int")).when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int")).otherwise(F.signum(a["period"] - b["period"]).cast("int")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    out = out.withColumn("best", F.when(F.size("runs") > 0, longest[0]))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best")["length"] / F.col("best")["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_lm_score, op2_line_dedup, op3_language_id, op4_bpe_tree, op5_jaccard_join, op6_exact_dedup, op7_decontam, op8_quality_cnn, op9_wavelet_tokens, op10_url_filter, op11_prefix_trie, op12_simhash, op13_periodic_runs)}

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"



def _crc32(x: str) -> str:
    """Unsigned crc32 of the ASCII text x, bit by bit."""
    eight = ", ".join(["0::bigint"] * 8)
    bits = f"list_reduce(list_prepend(xor(crc, byte), [{eight}]), lambda t, z: case when t & 1 = 1 then xor(t >> 1, 3988292384) else t >> 1 end)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({x}, ''), lambda x: ascii(x)::bigint)), lambda crc, byte: {bits}), 4294967295)"


SQL: dict[str, str] = {
    "op11_prefix_trie": f"""
with turns as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
convs as (select conv_id, list({{'role': role, 'text': text}} order by pos) as own, {_crc32("conv_id::varchar")} % 6 as h from turns group by conv_id),
rebuilt as (select c.conv_id, list_concat(coalesce(list_slice(b.own, 1, c.h), []), coalesce(list_slice(c.own, c.h + 1, len(c.own)), [])) as said from convs c left join convs b on b.conv_id = c.conv_id - c.conv_id % 100),
passed as (select conv_id, said, unnest(range(len(said) + 1)) as depth from rebuilt),
keyed as (select conv_id, depth, list_slice(said, 1, depth) as path, depth = len(said) as ends from passed),
nodes as (select path, depth, min(conv_id) as conv_id, count(*) as n, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '') as ended,
  case when depth > 0 then (count(*) - 1) * length(list_last(path).text) else 0 end as saved from keyed group by path, depth),
families as (select n.*, p.conv_id as parent_conv_id, (select count(*) from nodes k where k.depth = n.depth + 1 and list_slice(k.path, 1, n.depth) = n.path) as n_children
  from nodes n left join nodes p on p.depth = n.depth - 1 and p.path = list_slice(n.path, 1, n.depth - 1)),
ups as (select path, n_children, saved, unnest(range(depth + 1)) as up from families),
sums as (select list_slice(path, 1, up) as path, up as depth, count(*) filter (where n_children = 0) as n_leaves, sum(saved)::bigint as saved_tokens from ups group by 1, 2)
select conv_id, f.depth, parent_conv_id, n as n_convs, n_children, n_leaves, saved_tokens, sha256(ended) as ends_sha256 from families f join sums s on s.depth = f.depth and s.path = f.path""",
    "op13_periodic_runs": f"""
with split as (select doc_id, {_WORDS} as w, {_crc32("doc_id::varchar")} as h from documents),
numbers as (select doc_id, w, len(w) as n, h % 10 = 0 and len(w) > 0 as chosen, case when len(w) > 0 then (h // 10) % len(w) end as a, 3 + (h // 10) % 8 as c from split),
texts as (select doc_id, n, case when chosen then list_transform(range(n), lambda i: w[case when i >= a then a + (i - a) % (1 + (n - a) // c) else i end + 1]) else w end as w from numbers),
places as (select doc_id, n, unnest(range(n)) as i, unnest(w) as x from texts),
equal as (select u.doc_id, u.i, v.i - u.i as q from places u join places v on u.doc_id = v.doc_id and u.x = v.x and v.i > u.i and 4 * (v.i - u.i) <= u.n),
stretches as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as island from equal),
long_ones as (select doc_id, q, min(i) as s, count(*) + q as l from stretches group by doc_id, q, island having count(*) + q >= greatest(6, 4 * q)),
runs as (select * from long_ones r where not exists (select 1 from long_ones o where o.doc_id = r.doc_id and o.q < r.q and o.s <= r.s and o.s + o.l >= r.s + r.l)),
ranked as (select *, row_number() over (partition by doc_id order by l desc, s, q) as place from runs),
told as (select doc_id, count(*)::bigint as n_runs, max(s) filter (where place = 1) as start, max(l) filter (where place = 1) as length, max(q) filter (where place = 1) as period,
  string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) as lines from ranked group by doc_id),
gone as (select distinct doc_id, unnest(range(s + q, s + l)) as i from runs),
kept as (select p.doc_id, string_agg(p.x, ' ' order by p.i) as left_over from places p anti join gone g on p.doc_id = g.doc_id and p.i = g.i group by p.doc_id)
select t.doc_id, coalesce(n_runs, 0) as n_runs, start, length, period, (1000 * length) // period as exponent_milli,
  sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(left_over, '')) as collapsed_sha256
from texts t left join told using (doc_id) left join kept using (doc_id)""",
    "op5_jaccard_join": f"""
with recursive words as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_AZ}), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') as w from documents),
sets as (select doc_id, list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from words),
keyed as (select doc_id, len(s) as n, list_sort(s) as k, s from sets),
classes as (select k, min(doc_id) as rep, any_value(n) as n, any_value(s) as s from keyed where n > 0 group by k),
elements as (select rep, n, unnest(s) as e from classes),
pairs as (select a.rep as a, b.rep as b, count(*) as c, any_value(a.n) as n, any_value(b.n) as m from elements a join elements b on a.e = b.e and a.rep < b.rep and least(a.n, b.n) * 100 >= 90 * greatest(a.n, b.n) group by 1, 2),
links as (select a, b from pairs where 100 * c >= 90 * (n + m - c)),
both_ways as (select a, b from links union all select b, a from links),
reach(node, root) as (select rep, rep from classes union select x.b, r.root from reach r join both_ways x on x.a = r.node),
roots as (select node, min(root) as root from reach group by node)
select keyed.doc_id, keyed.n::bigint as n_shingles, coalesce(roots.root, keyed.doc_id) as component_id from keyed left join classes using (k) left join roots on roots.node = classes.rep""",
    "op2_line_dedup": f"""
with split as (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
lines as (select doc_id, unnest(parts) as line, unnest(range(len(parts))) as pos from split),
keyed as (select doc_id, pos, line, translate(trim(line, {_SPACE}), {_AZ}) as key from lines),
shared as (select key, max(doc_id) as owner from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
judged as (select k.doc_id, k.pos, k.line, s.owner is not null and s.owner <> k.doc_id as dropped from keyed k left join shared s using (key))
select doc_id, count(*)::bigint as n_lines, (count(*) filter (where dropped))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from judged group by doc_id""",
    "op6_exact_dedup": f"""
with bare as (select doc_id, length(coalesce(text, '')) as chars, translate(coalesce(text, ''), {_SPACE}, '') as norm from documents),
ranked as (select *, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as n, row_number() over w as place
  from bare window w as (partition by norm order by chars desc, doc_id nulls last))
select doc_id, keep_id, n::bigint as group_size, place = 1 as kept, sha256(norm) as text_sha256 from ranked""",
}
