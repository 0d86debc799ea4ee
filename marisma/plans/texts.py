"""Text queries: identity, sentences, lexicons, terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from marisma.functions import hashing, text
from marisma.operators import dedup, facets, lexicon
from marisma.plans.kit import LETTERS, LEXICON, SENTENCES, STOP, collapse_sql, docs, hits_sql, lexicon_sql, tokens_sql, word_sql
from marisma.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"select doc_id, sha256({collapse_sql('lower(text)')}) as text_sha256 from documents")
def text_hash(spark, d):
    return docs(spark, d).select("doc_id", hashing.sha(text.normalise(F.col("text"))).alias("text_sha256"))


@query("select page_id, 'CNT-' || substr(sha256(trim(url)), 1, 12) as content_id, sha256(trim(url)) as url_sha256 from pages")
def content_ids(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", hashing.content_id(F.col("url"), F.lit("")).alias("content_id"), hashing.sha(F.trim("url")).alias("url_sha256"))


@query("""select doc_id, case when h % 100 < 70 then 'train' when h % 100 < 85 then 'val' else 'test' end as split
from (select doc_id, ('0x' || substr(sha256(text), 1, 8))::bigint as h from documents)""")
def split_assign(spark, d):
    return docs(spark, d).select("doc_id", hashing.split_of(hashing.sha(F.col("text"))).alias("split"))


@query(f"select min(doc_id) as doc_id, h as text_sha256, count(*)::bigint as copies from (select doc_id, sha256({collapse_sql('lower(text)')}) as h from documents) group by h")
def dedup_text_first(spark, d):
    rows = docs(spark, d).select("doc_id", hashing.sha(text.normalise(F.col("text"))).alias("text_sha256"))
    return rows.groupBy("text_sha256").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "text_sha256", "copies")


@query(f"""with recursive s as (select doc_id, substr(sha256({collapse_sql('lower(text)')}), 1, 16) as t, n_chars % 97 || ':' || lang || ':' || source as u from documents),
o as (select *, row_number() over (order by doc_id) as i from s),
w(i, kept, us, ts) as (select 0::bigint, false, []::varchar[], []::varchar[]
  union all select o.i, not (list_contains(w.us, o.u) or list_contains(w.ts, o.t)),
    case when list_contains(w.us, o.u) or list_contains(w.ts, o.t) then w.us else list_append(w.us, o.u) end,
    case when list_contains(w.us, o.u) or list_contains(w.ts, o.t) then w.ts else list_append(w.ts, o.t) end from w join o on o.i = w.i + 1)
select o.doc_id from w join o using (i) where w.kept""")
def dedup_cascade(spark, d):
    rows = docs(spark, d).select("doc_id", F.substring(hashing.sha(text.normalise(F.col("text"))), 1, 16).alias("t"), F.concat_ws(":", F.col("n_chars") % 97, "lang", "source").alias("u"))
    return dedup.cascade(rows, ["u", "t"], "doc_id").select("doc_id")


@query(f"select doc_id, count(*)::bigint as n, max(length(s))::bigint as longest from ({SENTENCES}) group by doc_id")
def sentence_split_count(spark, d):
    s = docs(spark, d).select("doc_id", F.explode_outer(text.sentences(F.col("text"))).alias("s")).where("s is not null")
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("s")).cast("long").alias("longest"))


def _modality_sql(s: str) -> str:
    strip = lambda p: p.replace("(?i)", "").replace("\\b", "")
    word = lambda p: f"regexp_matches({s}, '(?i)(^|[^a-z0-9_áéíóúñü]){strip(p)}([^a-z0-9_áéíóúñü]|$)')"
    return f"""case when {s} like '%?' or {s} like '¿%' or lower({s}) like 'qué %' or lower({s}) like 'que %' then 'pregunta' when {word(text.NEGATION)} then 'negacion' when {word(text.QUOTE)} then 'cita'
      when {word(text.DESCRIPTION)} then 'descripcion' when {word(text.HYPOTHESIS)} then 'hipotesis' when regexp_matches({s}, '{text.OPINION}') then 'opinion' else 'afirmacion' end"""


@query(f"select modality, count(*)::bigint as n from (select {_modality_sql('s')} as modality from ({SENTENCES})) group by modality")
def modality_counts(spark, d):
    s = docs(spark, d).select(F.explode(text.sentences(F.col("text"))).alias("s"))
    return s.groupBy(text.modality(F.col("s")).alias("modality")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""select doc_id, case when length(w) < 40 or len(p) < 2 then 1 else least(len(p), 8) end::bigint as pieces from (
  select doc_id, w, list_filter(list_transform(string_split_regex(w, ', (?:and|und|et|y) | that '), lambda x: trim(x, ' ,.;')), lambda x: length(x) >= 18) as p
  from (select doc_id, {collapse_sql('text')} as w from documents))""")
def compound_split(spark, d):
    return docs(spark, d).select("doc_id", F.size(text.split_compound(F.col("text"), cut=r", (?:and|und|et|y) | that ")).cast("long").alias("pieces"))


@query(f"select doc_id, len(t)::bigint as n, coalesce(list_aggregate(list_transform(t, lambda x: length(x)), 'sum'), 0)::bigint as letters from (select doc_id, {tokens_sql('text')} as t from documents)")
def token_set(spark, d):
    t = text.tokens(F.col("text"), STOP)
    return docs(spark, d).select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("letters"))


@query(f"""with a as (select conv_id, {tokens_sql('text')} as t from conversations where turn = 0), b as (select conv_id, {tokens_sql('text')} as t from conversations where turn = 1)
select a.conv_id, case when len(list_filter(a.t, lambda x: length(x) >= 5)) = 0 then 0.0 else len(list_intersect(list_filter(a.t, lambda x: length(x) >= 5), list_filter(b.t, lambda x: length(x) >= 5)))::double / len(list_filter(a.t, lambda x: length(x) >= 5)) end as share from a join b using (conv_id)""")
def token_overlap(spark, d):
    c = table(spark, d, "conversations")
    a = c.where("turn = 0").select("conv_id", text.tokens(F.col("text"), STOP).alias("a"))
    b = c.where("turn = 1").select("conv_id", text.tokens(F.col("text"), STOP).alias("b"))
    return a.join(b, "conv_id").select("conv_id", text.overlap_share(F.col("a"), F.col("b")).alias("share"))


_HITS = hits_sql("documents", "doc_id", "text")


@query(f"select term, category, count(*)::bigint as docs from ({_HITS}) group by term, category")
def lexicon_hits(spark, d):
    h = docs(spark, d).select("doc_id", F.explode_outer(lexicon.hits(F.col("text"), LEXICON)).alias("h")).where("h is not null")
    return h.groupBy(F.col("h.term").alias("term"), F.col("h.category").alias("category")).agg(F.count(F.lit(1)).alias("docs"))


_SCORED = f"select d.doc_id, count(h.term) as n, least(1.0::double, count(h.term) / 3.0::double) as score from documents d left join ({_HITS}) h using (doc_id) group by d.doc_id"


@query(f"select doc_id, score from ({_SCORED})")
def relevance_score(spark, d):
    return docs(spark, d).select("doc_id", lexicon.relevance(F.size(lexicon.hits(F.col("text"), LEXICON))).alias("score"))


@query(f"select case when score < 0.15 then 'discard' when score < 0.5 then 'low' when score < 0.8 then 'analyze' else 'high' end as bucket, count(*)::bigint as n from ({_SCORED}) group by bucket")
def relevance_bucket(spark, d):
    score = lexicon.relevance(F.size(lexicon.hits(F.col("text"), LEXICON)))
    return docs(spark, d).groupBy(lexicon.relevance_bucket(score).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with c as (select distinct doc_id, category from ({_HITS})), n as (select coalesce(c.category, 'otras') as label, count(*)::bigint as n from documents d left join c using (doc_id) group by label) select label, n from n""")
def disease_multilabel(spark, d):
    own = F.array_distinct(F.transform(lexicon.hits(F.col("text"), LEXICON), lambda h: h["category"]))
    return docs(spark, d).select(F.explode_outer(own).alias("label")).groupBy(F.coalesce("label", F.lit("otras")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


_SENTENCE_HITS = f"select h.* exclude (skey), skey.doc_id as doc_id, skey.pos as spos from ({hits_sql('(select {doc_id: doc_id, pos: pos} as skey, s from (' + SENTENCES + '))', 'skey', 's')}) h"


@query(f"select term, count(*)::bigint as n from ({_SENTENCE_HITS}) group by term order by n desc, term limit 8")
def term_cloud_topk(spark, d):
    return lexicon.term_cloud(lexicon.sentence_hits(docs(spark, d), "doc_id", LEXICON), 8)


_FORCE = "case when n >= 40 then 5 when n >= 20 then 4 when n >= 8 then 3 when n >= 3 then 2 else 1 end"


@query(f"""with c as (select distinct doc_id, spos, category from ({_SENTENCE_HITS})),
p as (select x.category as a, y.category as b, count(*)::bigint as n, count(distinct x.doc_id)::bigint as docs from c x join c y using (doc_id, spos) where x.category < y.category group by 1, 2)
select a, b, n, docs, least(5, {_FORCE} + 1)::int as force from p""")
def pair_cooccurrence_force(spark, d):
    return lexicon.category_pairs(lexicon.sentence_hits(docs(spark, d), "doc_id", LEXICON), "doc_id")


@query(f"""with h as (select doc_id, category from ({_HITS})), c as (select category, (count(distinct doc_id) filter (where doc_id % 2 = 1))::bigint as n, (count(distinct doc_id) filter (where doc_id % 2 = 0))::bigint as before from h group by category)
select category, n, before, case when before = 0 then case when n > 0 then 100.0 else 0.0 end else round((n - before) * 100.0::double / before, 1) end as growth from c""")
def keyword_cluster_growth(spark, d):
    own = F.array_distinct(F.transform(lexicon.hits(F.col("text"), LEXICON), lambda h: h["category"]))
    rows = docs(spark, d).select("doc_id", F.explode_outer(own).alias("category")).where("category is not null")
    n = rows.groupBy("category").agg(F.count_if(F.col("doc_id") % 2 == 1).alias("n"), F.count_if(F.col("doc_id") % 2 == 0).alias("before"))
    growth = F.when(F.col("before") == 0, F.when(F.col("n") > 0, 100.0).otherwise(0.0)).otherwise(F.round((F.col("n") - F.col("before")) * 100.0 / F.col("before"), 1))
    return n.withColumn("growth", growth)


@query(f"""select doc_id, {collapse_sql('lower(text)')} = lower(text) as is_flat, translate(lower(text), '{text.ACCENTED}', '{text.PLAIN}') as folded from documents""")
def normalise_fold(spark, d):
    return docs(spark, d).select("doc_id", (text.normalise(F.col("text")) == F.lower("text")).alias("is_flat"), text.fold_accents(F.col("text")).alias("folded"))


@query(f"select (count(*) filter (where {word_sql('lower(text)', 'is')}))::bigint as bare, (count(*) filter (where {word_sql(chr(39).join(['replace(lower(text), ', 'that is', ', ', ' ', ')']), 'is')}))::bigint as masked from documents")
def mask_then_match(spark, d):
    return docs(spark, d).agg(F.count_if(text.has_word(F.col("text"), "is")).alias("bare"), F.count_if(text.has_word(text.mask(F.col("text"), ["that is"]), "is")).alias("masked"))


_MARKERS = {"en": (" the ", " and ", " of "), "fr": (" les ", " des ", " et "), "de": (" der ", " und ", " die "), "es": (" los ", " con ", " del ")}


def _votes_sql() -> str:
    v = {k: " + ".join(f"contains(' ' || lower(text) || ' ', '{m}')::int" for m in ms) for k, ms in _MARKERS.items()}
    best = f"greatest({', '.join(v.values())})"
    return f"case when length(text) < 12 or text is null or {best} = 0 then 'und' " + " ".join(f"when {x} = {best} then '{k}'" for k, x in v.items()) + " end"


@query(f"select doc_id, {_votes_sql()} as hint from documents")
def lang_hint(spark, d):
    return docs(spark, d).select("doc_id", text.language_votes(F.col("text"), _MARKERS).alias("hint"))


@query(f"""select page_id, trim(regexp_replace(translate(lower(url), '{text.ACCENTED}', '{text.PLAIN}'), '[^a-z0-9]+', '-', 'g'), '-') as slug,
 replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') as xml from pages""")
def slug_escape(spark, d):
    return table(spark, d, "pages").select("page_id", text.slug(F.col("url")).alias("slug"), text.escape_xml(F.col("url")).alias("xml"))


@query(f"select doc_id, case when length(f) <= 60 then f else regexp_replace(substr(f, 1, 60), '\\s+\\S*$', '') || '…' end as excerpt from (select doc_id, {collapse_sql('text')} as f from documents)")
def excerpts(spark, d):
    return docs(spark, d).select("doc_id", text.excerpt(F.col("text"), 60).alias("excerpt"))


@query("""select lang, source, count(*)::bigint as n, 'Source ' || source || ' gave ' || count(*) || ' texts in ' || lang || '.' as prose from documents group by lang, source""")
def prose_template(spark, d):
    n = docs(spark, d).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("prose", F.format_string("Source %s gave %d texts in %s.", "source", "n", "lang"))


_TERMS = [("the", "en", 9, 1), ("of", "en", 0, 1), ("les", "fr", 3, 0), ("und", "de", 4, 1)]


@query("with e(term, category, weight, active) as (values " + ", ".join(map(str, _TERMS)) + f"""), a as (select term, category, least(greatest(weight, 1), 5)::int as weight from e where active = 1)
select * from a union all select term, category, weight::int from {lexicon_sql()} where category not in (select category from a)""")
def term_bank_overlay(spark, d):
    return lexicon.overlay(spark.createDataFrame(LEXICON, "term string, category string, weight int"), spark.createDataFrame(_TERMS, "term string, category string, weight int, active int"))


@query("""with c(text, translated) as (values ('Re eroundth', 'x'), ('The', 'y')), d as (select doc_id, split_part(text, ' ', 1) as w from documents),
h as (select sha256('en|es' || chr(10) || text) as k, translated from c)
select doc_id, w, coalesce(translated, w) as shown, translated is not null as cached from d left join h on h.k = sha256('en|es' || chr(10) || w)""")
def translation_cache_join(spark, d):
    cache = spark.createDataFrame([("Re eroundth", "x"), ("The", "y")], "source string, translated string")
    cache = cache.select(hashing.sha(F.concat(F.lit("en|es\n"), "source")).alias("k"), "translated")
    rows = docs(spark, d).select("doc_id", F.substring_index("text", " ", 1).alias("w")).withColumn("k", hashing.sha(F.concat(F.lit("en|es\n"), "w")))
    return rows.join(F.broadcast(cache), "k", "left").select("doc_id", "w", F.coalesce("translated", "w").alias("shown"), F.col("translated").isNotNull().alias("cached"))


@query("""select conv_id, turn, len(list_filter(regexp_extract_all(text, '[^.!?]*[.!?]'), lambda s: length(trim(s)) >= 20))::bigint as claims,
 case when regexp_matches(text, '(?i)(^|[^a-z0-9_áéíóúñü])ocult') then 'OCULTA' when regexp_matches(text, '(?i)(^|[^a-z0-9_áéíóúñü])(confirm|report|detect|anuncia|declara)') then 'REPORTA' when regexp_matches(text, '(?i)(^|[^a-z0-9_áéíóúñü])(causa|provoca|produce)') then 'CAUSA'
 when regexp_matches(text, '(?i)(^|[^a-z0-9_áéíóúñü])(niega|desmiente)') then 'NIEGA' when regexp_matches(text, '(?i)(^|[^a-z0-9_áéíóúñü])vacun') then 'VACUNA' when regexp_matches(text, '(?i)(^|[^a-z0-9_áéíóúñü])(brote|outbreak)') then 'BROTE_EN' else 'AFIRMA' end as predicate from conversations""")
def claim_extract(spark, d):
    found = F.filter(F.regexp_extract_all("text", F.lit(r"([^.!?]*[.!?])"), 1), lambda s: F.length(F.trim(s)) >= 20)
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(found).cast("long").alias("claims"), text.predicate(F.col("text")).alias("predicate"))


@query("""select doc_id, list_max(n)::bigint as most from (select doc_id, list_filter(list_transform(regexp_extract_all(' ' || lower(text), '[^0-9](\\d{1,3}(?:[.,]\\d{3})+|\\d+)\\s*(?:%|-|\\.|,|@|\\))', 1), lambda x: try_cast(regexp_replace(x, '[.,]', '', 'g') as bigint)), lambda x: x between 1 and 5000000) as n from documents) where len(n) > 0""")
def numeric_extract_max(spark, d):
    n = F.filter(text.numbers(F.col("text"), r"%|-|\.|,|@|\)"), lambda x: x.between(1, 5_000_000))
    return docs(spark, d).select("doc_id", n.alias("n")).where(F.size("n") > 0).select("doc_id", F.array_max("n").alias("most"))


@query(f"""with s as (select doc_id, pos, row_number() over (partition by doc_id order by pos) as i from ({SENTENCES}) where length(s) >= 40),
w as (select s.doc_id, s.i, s.pos, h.pos as term, h.weight from s join ({_SENTENCE_HITS}) h on h.doc_id = s.doc_id and h.spos = s.pos),
both_ways as (select doc_id, i, term, weight from w union select doc_id, i - 1, term, weight from w where i > 1),
h as (select doc_id, i, sum(weight) as score from both_ways group by all)
select doc_id, pos::bigint as pos, score::bigint as score from (select h.*, s.pos, row_number() over (partition by doc_id order by score desc, i) as r from h join s using (doc_id, i)) where r = 1""")
def best_paragraph(spark, d):
    s = text.once(docs(spark, d).select("doc_id", "text"), all=text.sentences(F.col("text"))).select("doc_id", "all")
    kept = F.filter(F.transform("all", lambda x, i: F.struct(i.alias("pos"), x.alias("s"))), lambda x: F.length(x["s"]) >= 40)
    scored = F.transform(kept, lambda x: F.struct(x["pos"].alias("pos"), lexicon.hits(x["s"], LEXICON).alias("h")))
    rows = text.once(s, k=scored).select("doc_id", "k", F.posexplode("k").alias("i", "x"))
    pair = F.array_union("x.h", F.coalesce(F.try_element_at("k", F.col("i") + 2)["h"], F.array_compact(F.array(F.lit(None).cast("struct<term:string,category:string,weight:int>")))))
    score = F.aggregate(pair, F.lit(0).cast("long"), lambda a, h: a + h["weight"])
    best = rows.select("doc_id", F.struct((-score).alias("m"), F.col("x.pos").cast("long").alias("pos")).alias("b")).groupBy("doc_id").agg(F.min("b").alias("b"))
    return best.where("b.m < 0").select("doc_id", F.col("b.pos").alias("pos"), (-F.col("b.m")).alias("score"))


@query("""select lower(t) as key, min_by(t, doc_id) as shown, count(*)::bigint as n from (select doc_id, split_part(text, ' ', 1) as t from documents) group by lower(t)""")
def grouped_values_ci(spark, d):
    t = docs(spark, d).select("doc_id", F.substring_index("text", " ", 1).alias("t"))
    return t.groupBy(F.lower("t").alias("key")).agg(F.min(F.struct("doc_id", "t")).alias("f"), F.count(F.lit(1)).alias("n")).select("key", F.col("f.t").alias("shown"), "n")


@query("""select lang, doc_id, n_chars from (select *, row_number() over (partition by lang order by n_chars desc, doc_id) as r from documents) where r <= case lang when 'en' then 9 when 'fr' then 4 else 2 end""")
def class_capped_import(spark, d):
    rows = facets.top_per_group(docs(spark, d).select("lang", "doc_id", "n_chars"), ["lang"], [F.desc("n_chars"), F.col("doc_id")], 9)
    return rows.where(F.col("turn") <= F.when(F.col("lang") == "en", 9).when(F.col("lang") == "fr", 4).otherwise(2)).select("lang", "doc_id", "n_chars")


@query(f"""with h as (select doc_id, list_distinct(list(category)) as c from ({_HITS}) group by doc_id), b as (select item_id, list_distinct(list(category)) as c from ({hits_sql('benchmark', 'item_id', 'text')}) group by item_id),
p as (select d.doc_id, b.item_id, coalesce(h.c, []) as x, b.c as y from documents d left join h using (doc_id) join b on b.item_id = d.doc_id)
select doc_id, len(list_intersect(x, y))::bigint as shared, len(list_filter(y, lambda v: not list_contains(x, v)))::bigint as missing, len(list_filter(x, lambda v: not list_contains(y, v)))::bigint as extra,
 case when len(list_intersect(x, y)) = 0 then 'none' when len(list_filter(y, lambda v: not list_contains(x, v))) = 0 then 'hit' else 'partial' end as status from p""")
def fact_compare(spark, d):
    own = lambda c: F.array_distinct(F.transform(lexicon.hits(F.col(c), LEXICON), lambda h: h["category"]))
    a = docs(spark, d).select("doc_id", own("text").alias("x"))
    b = text.once(table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), y=own("text")).where(F.size("y") > 0).select("doc_id", "y")
    shared, missing = F.size(F.array_intersect("x", "y")), F.size(F.array_except("y", "x"))
    status = F.when(shared == 0, "none").when(missing == 0, "hit").otherwise("partial")
    return a.join(b, "doc_id").select("doc_id", shared.cast("long").alias("shared"), missing.cast("long").alias("missing"), F.size(F.array_except("x", "y")).cast("long").alias("extra"), status.alias("status"))
