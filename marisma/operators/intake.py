"""What comes in and what is kept of it: imports with caps, sources that are due, purges, listings, merges of two stores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marisma.functions import dates, pictures
from marisma.operators import facets

# How many articles, papers and posts one import takes; minutes between visits by priority; ways to read a source; addresses that are purged.
CAPS = {"news": 90, "paper": 25, "social": 40}
MINUTES = {"critical": 15, "high": 30, "normal": 60, "low": 360, "scientific": 720}
WAYS = ("api", "rss", "scrape")
PURGED = ("%example.invalid%", "%example.com%", "%social.local%", "http://localhost%", "https://localhost%", "%rumor-vacuna%", "%poultryworld.net/demo%", "%woah.org/en/demo%")
# Columns that the mirror takes over where a row is there already; all others stay as they were first.
MIRRORED = {"articles": ("title",), "claims": ("nli_label", "verdict", "confidence"), "evidence": ("snippet",), "entities": ("value",), "images": ("cnn_class", "cnn_confidence"), "alerts": ("risk_score",), "cnn_samples": ("confidence",)}


def imported(docs: DataFrame, key: str) -> DataFrame:
    """Articles and papers (url, title, text, snippet, kind, lang, fetched, status) of an import: key, class, url, title, text, turn.

    Only what is valid counts against a cap: active, with a web address that is not made up and a title of eight characters. The newest come first, papers after
    all articles; of equal ones the smaller key.
    """
    url, title = F.coalesce("url", F.lit("")), F.trim(F.coalesce("title", F.lit("")))
    rows = docs.where((F.col("status") == "active") & url.startswith("http") & ~pictures.is_fake(url) & (F.length(title) >= 8))
    paper = F.contains(url, F.lit("openalex.org"))
    body = F.trim(F.coalesce(F.nullif(F.col("text"), F.lit("")), F.nullif(F.col("snippet"), F.lit("")), title))
    rows = rows.select(key, F.when(paper, "paper").otherwise("news").alias("class"), url.alias("url"), title.alias("title"), F.coalesce(F.nullif(F.substring(body, 1, 2500), F.lit("")), title).alias("text"), "fetched")
    top = facets.top_per_group(rows, ["class"], [F.desc_nulls_last("fetched"), F.col(key)], max(CAPS["news"], CAPS["paper"]))
    return top.where(F.col("turn") <= F.when(F.col("class") == "paper", CAPS["paper"]).otherwise(CAPS["news"])).select(key, "class", "url", "title", "text", "turn")


def imported_posts(posts: DataFrame, key: str) -> DataFrame:
    """Posts (content, url, created) of an import, newest first: key, url (a place inside the application where it has none that may be shown), title, text, turn."""
    text = F.trim(F.coalesce("content", F.lit("")))
    rows = posts.where(text != "").select(F.lit("social").alias("class"), key, F.coalesce(F.nullif(pictures.public_url(F.col("url")), F.lit("")), F.concat(F.lit("inapp:social/"), F.col(key).cast("string"))).alias("url"), F.substring(text, 1, 140).alias("title"), text.alias("text"), "created")
    return facets.top_per_group(rows, ["class"], [F.desc_nulls_last("created"), F.col(key)], CAPS["social"]).select(key, "class", "url", "title", "text", "turn")


def way(declared: Column, api: Column, rss: Column, kind: Column) -> Column:
    """How a source is read: by an interface where it has one or gathers others' without a feed, else by its feed, else as declared, else page by page."""
    low, feed = F.lower(F.coalesce(declared, F.lit(""))), F.coalesce(rss, F.lit("")) != ""
    api = (low == "api") | (F.coalesce(api, F.lit("")) != "") | ((F.coalesce(kind, F.lit("")) == "aggregator") & ~feed)
    return F.when(api, "api").when(feed, "rss").when(low.isin(*WAYS), low).otherwise("scrape")


def minutes(frequency: Column, priority: Column) -> Column:
    """Minutes between visits: as stated, else by priority."""
    out = F.lit(MINUTES["normal"])
    for name, n in MINUTES.items():
        out = F.when(F.coalesce(priority, F.lit("normal")) == name, n).otherwise(out)
    return F.coalesce(F.nullif(frequency.cast("int"), F.lit(0)), out)


def due(sources: DataFrame, key: str, now: Column, methods: Sequence[str] = ("api", "rss"), force: bool = False) -> DataFrame:
    """Active sources (access_method, api_url, rss_url, type, frequency_minutes, priority, next_check, last_checked, active, confidence) that are to be visited: key, method, minutes, url, confidence.

    The next visit is as stored, else a stretch after the last one, else now; force asks for all. They come by minutes, then by key.
    """
    rows = sources.withColumns({"method": way(F.col("access_method"), F.col("api_url"), F.col("rss_url"), F.col("type")), "minutes": minutes(F.col("frequency_minutes"), F.col("priority"))})
    rows = rows.where(F.coalesce("active", F.lit(True)) & F.col("method").isin(*methods))
    if not force:
        rows = rows.where(F.coalesce("next_check", F.col("last_checked") + F.make_interval(mins=F.col("minutes")), now) <= now)
    url = F.when(F.col("method") == "api", F.col("api_url")).when(F.col("method") == "rss", F.col("rss_url"))
    return rows.select(key, "method", "minutes", url.alias("url"), (F.coalesce("confidence", F.lit(0)) * 10).cast("int").alias("confidence")).orderBy("minutes", key)


def later(failures: Column, now: Column) -> Column:
    """When a source that failed is visited again: after half a minute, two minutes, then six hours."""
    return now + F.when(failures <= 1, F.make_interval(secs=F.lit(30))).when(failures == 2, F.make_interval(mins=F.lit(2))).otherwise(F.make_interval(hours=F.lit(6)))


def with_runtime(sources: DataFrame, seen: DataFrame, key: str, columns: Sequence[str] = ("last_checked", "next_check", "last_error", "consecutive_failures", "last_success")) -> DataFrame:
    """sources with what was seen of them: of the columns each value that is not null wins over the listed one."""
    new = seen.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in columns])
    return sources.join(new, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in sources.columns], *[F.col(f"_{c}").alias(c) for c in columns if c not in sources.columns])


def _like(url: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | url.ilike(p)
    return F.coalesce(out, F.lit(False))


def purged(articles: DataFrame, key: str, children: Mapping[str, DataFrame], claims: DataFrame, claim: str, evidence: DataFrame) -> tuple[DataFrame, dict[str, DataFrame], DataFrame, DataFrame]:
    """Articles without those of made-up addresses, children by key without theirs, claims, and evidence without theirs; of the evidence that stays addresses that are purged or are no web address become empty."""
    doomed = articles.where(_like(F.col("url"), PURGED)).select(key)
    gone = claims.join(doomed, key, "left_semi").select(claim)
    keep = lambda t: t.join(doomed, key, "left_anti")
    url = F.when(_like(F.col("url"), PURGED) | F.coalesce(~F.col("url").ilike("http%"), F.lit(False)), "").otherwise(F.col("url"))
    return keep(articles), {n: keep(t) for n, t in children.items()}, keep(claims), evidence.join(gone, claim, "left_anti").withColumn("url", url)


def listing_order(published: Column, collected: Column) -> list[Column]:
    """The order of the plain listing: by date of publication, else of collection, newest first; what is no ISO date comes last, by collection."""
    return [F.desc_nulls_last(dates.iso(F.coalesce(F.nullif(published, F.lit("")), collected))), F.desc_nulls_last(collected)]


def shown_order(published: Column, collected: Column) -> list[Column]:
    """The order of filtered articles: those with a date of publication first, then by that date, else by that of collection."""
    own = dates.iso(published)
    return [F.desc(F.when(own.isNotNull(), 1).otherwise(0)), F.desc_nulls_last(F.coalesce(own, dates.iso(collected)))]


def chosen_claims(claims: DataFrame, key: str, members: DataFrame, part: str = "", mode: str = "", modality: Column | None = None) -> DataFrame:
    """Claims of a narrative's members (all where it has none), with a part of text and of a mode."""
    any_member = members.select(F.lit(1).alias("_n")).limit(1).agg(F.count(F.lit(1)).alias("_members"))
    rows = claims.join(members.select(key, F.lit(True).alias("_in")).distinct(), key, "left").crossJoin(F.broadcast(any_member)).where((F.col("_members") == 0) | F.col("_in")).select(*claims.columns)
    if part:
        rows = rows.where(F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit(part.lower())))
    return rows.where(modality == mode) if mode and modality is not None else rows


def mirrored(old: DataFrame, new: DataFrame, table: str, key: str, order: str) -> DataFrame:
    """The mirror's table after rows came: a new key is added as its first row, and of all rows of a key the last one's columns that are taken over win; rows of one place in the order go by their columns."""
    update = MIRRORED[table]
    rows = old.withColumn("_turn", F.lit(0)).withColumn("_at", F.lit(None).cast("bigint")).unionByName(new.select(*old.columns, F.lit(1).alias("_turn"), F.col(order).cast("bigint").alias("_at")))
    at = F.struct("_turn", "_at", *[c for c in old.columns if c != key])
    out = rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in old.columns if c != key]), at).alias("first"), F.max_by(F.struct(*update), at).alias("last"))
    return out.select(*[F.col(c) if c == key else F.col("last")[c].alias(c) if c in update else F.col("first")[c].alias(c) for c in old.columns])


def present(asked: DataFrame, key: str, *stores: DataFrame) -> DataFrame:
    """asked with there: whether any of the stores has its key."""
    known = None
    for s in stores:
        known = s.select(key) if known is None else known.union(s.select(key))
    return asked.join(known.where(F.col(key).isNotNull()).distinct().withColumn("there", F.lit(True)), key, "left").select(*asked.columns, F.coalesce("there", F.lit(False)).alias("there"))


def photo_samples(videos: DataFrame, thumbs: DataFrame, images: DataFrame, most: int = 24, first: int = 8) -> DataFrame:
    """Real pictures to show, of tables (path, at): the newest `first` stills of videos, then the newest thumbnails, then images; each path once, where it comes first; 12 to 24 in all: path, tier, turn."""
    most = max(12, min(24, most))
    tiers = None
    for tier, (t, n) in enumerate(((videos, first), (thumbs, most), (images, most))):
        # enough newest distinct paths of each tier, by an aggregate before the cut
        some = t.where(F.coalesce("path", F.lit("")) != "").groupBy("path").agg(F.max("at").alias("at")).orderBy(F.desc("at"), "path").limit(n + (most if tier else 0)).withColumn("tier", F.lit(tier))
        tiers = some if tiers is None else tiers.unionByName(some)
    one = tiers.groupBy("path").agg(F.min(F.struct("tier", "at")).alias("r")).select(F.lit(1).alias("g"), "path", "r.tier", "r.at")
    return facets.top_per_group(one, ["g"], [F.col("tier"), F.desc("at"), F.col("path")], most).select("path", "tier", "turn")


def capture(rows: DataFrame, seeds: Sequence[str], feeds: Sequence[str], short: int = 500) -> DataFrame:
    """How complete what was captured is, one row: total, by feed, seeded, without a body, percents of these, and counts by format (a map)."""
    formats = rows.groupBy(F.lower(F.coalesce("raw_format", F.lit(""))).alias("f")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length(F.coalesce("text", F.lit(""))) < short).alias("bare"))
    total, of = F.sum("n"), lambda names: F.coalesce(F.sum(F.when(F.col("f").isin(*names), F.col("n"))), F.lit(0))
    share = lambda x: F.when(total == 0, 0).otherwise(F.bround(x * 100.0 / total, 0)).cast("bigint")
    fed, seeded, bare = of(feeds), of(seeds), F.coalesce(F.sum("bare"), F.lit(0))
    by = F.map_from_entries(F.array_sort(F.collect_list(F.struct("f", "n"))))
    return formats.agg(F.coalesce(total, F.lit(0)).alias("total"), fed.alias("fed"), seeded.alias("seeded"), bare.alias("no_body"), share(fed).alias("fed_percent"), share(seeded).alias("seeded_percent"), share(bare).alias("no_body_percent"), by.alias("by_format"))
