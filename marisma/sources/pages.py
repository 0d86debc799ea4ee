"""Raw web pages: titles, main text, links, images, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marisma.functions import text, urls


# Parts of a page that are no text of its own, places where an article stands, and links that lead to none.
FURNITURE = ("script", "style", "nav", "footer", "header", "aside", "form", "noscript")
PLACES = ("article", "main", "[role='main']", ".article-body", ".entry-content", ".post-content", ".news-article", ".c-article-body", "#content", ".content")
SKIPPED = ("/login", "/privacy", "/cookie", "/tag/", "/tags/", "/share", "javascript:", "mailto:", "#")


def title(html: Column) -> Column:
    """og:title, else the title element."""
    og = F.regexp_extract(html, r"""(?i)<meta[^>]*property=["']og:title["'][^>]*content=["']([^"']*)["']""", 1)
    return F.coalesce(text.non_empty(og), text.non_empty(text.collapse(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))))


def main_text(html: Column, most: int = 20000) -> Column:
    """Visible text without scripts, styles and page furniture, at most `most` characters, cut at a word."""
    body = html
    for tag in FURNITURE:
        body = F.regexp_replace(body, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    flat = text.strip_html(body)
    return F.when(F.length(flat) <= most, flat).otherwise(F.regexp_replace(F.substring(flat, 1, most), r"\s+\S*$", ""))


def links(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """One row for each link of each page, with its position."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)<a\b[^>]*href=["']([^"'#]+)["']"""), 1)
    return pages.select(key, F.posexplode(found).alias("pos", "href"))


def listing(pages: DataFrame, key: str, url: str, most: int, html: str = "html") -> DataFrame:
    """Links of a page that stay on its host (or name none), distinct in order, at most `most` of a page."""
    found = F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(r"""(?i)<a\b[^>]*href=["']([^"'#]+)["']"""), 1))
    own = F.filter(found, lambda h: (urls.host(h) == urls.host(F.col(url))) | h.startswith("/"))
    return pages.select(key, F.posexplode(F.slice(own, 1, most)).alias("pos", "href"))


def _place(selector: str) -> str:
    """A pattern of the first element that a selector names, up to the end of its like; the text is its last group."""
    if selector[0] == ".":
        return rf"""(?is)<(\w+)\b[^>]*\bclass=["'](?:[^"']* )?{selector[1:]}(?: [^"']*)?["'][^>]*>(.*)</\1>"""
    if selector[0] == "#":
        return rf"""(?is)<(\w+)\b[^>]*\bid=["']{selector[1:]}["'][^>]*>(.*)</\1>"""
    if selector[0] == "[":
        return r"""(?is)<(\w+)\b[^>]*\brole=["']main["'][^>]*>(.*)</\1>"""
    return rf"(?is)<({selector})\b[^>]*>(.*?)</{selector}>"


def article_text(html: Column, least: int = 200, most: int = 20000) -> Column:
    """The text of the first place of an article that has more than `least` characters, else that of the whole body, without page furniture."""
    bare = html
    for tag in FURNITURE:
        bare = F.regexp_replace(bare, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    body = F.regexp_extract(bare, r"(?is)<body\b[^>]*>(.*)</body>", 1)
    flat = text.strip_html(F.when(body != "", body).otherwise(bare))
    for selector in reversed(PLACES):
        own = text.strip_html(F.regexp_extract(bare, _place(selector), 2))
        flat = F.when(F.length(own) > least, own).otherwise(flat)
    return F.when(F.length(flat) <= most, flat).otherwise(F.regexp_replace(F.substring(flat, 1, most), r"\s+\S*$", ""))


def article_links(pages: DataFrame, key: str, url: str, most: int = 12, html: str = "html", shortest: int = 12) -> DataFrame:
    """Links of a listing page to its articles: key, pos, href, title.

    Links to logins, tags and the like are left out, relative ones are resolved; a link stays that leads to the page's host or one below it, is not the
    page itself, and whose text (else address) has `shortest` characters; each address once, the first `most` (30 at most) of a page.
    """
    anchors = F.regexp_extract_all(F.col(html), F.lit(r"""(?is)(<a\b[^>]*href=["'][^"']+["'][^>]*>.*?</a>)"""), 1)
    rows = pages.select(key, F.col(url).alias("page"), F.posexplode_outer(anchors).alias("pos", "a")).where("a is not null")
    rows = text.once(rows, href=F.trim(F.regexp_extract("a", r"""(?is)href=["']([^"']+)["']""", 1)), title=text.strip_html(F.col("a")))
    skip = F.lit(False)
    for s in SKIPPED:
        skip = skip | F.contains(F.lower("href"), F.lit(s))
    root = F.regexp_extract("page", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    rows = rows.where(~skip).withColumn("href", F.when(F.col("href").startswith("//"), F.concat(F.lit("https:"), "href")).when(F.col("href").startswith("/"), F.concat(root, "href")).otherwise(F.col("href")))
    host = lambda c: F.lower(F.regexp_extract(c, "^https?://([^/?#:]*)", 1))
    rows = rows.withColumn("title", F.when(F.col("title") == "", F.col("href")).otherwise(F.col("title"))).where(F.col("href").startswith("http") & ((host("page") == "") | (host("href") == "") | (host("href") == host("page")) | host("href").endswith(F.concat(F.lit("."), host("page")))))
    rows = rows.where((F.rtrim("href", F.lit("/")) != F.rtrim("page", F.lit("/"))) & (F.length("title") >= shortest))
    first = rows.groupBy(key, "href").agg(F.min(F.struct("pos", "title")).alias("f"))
    turn = F.row_number().over(Window.partitionBy(key).orderBy("f.pos"))
    return first.withColumn("turn", turn).where(F.col("turn") <= max(1, min(30, most))).select(key, (F.col("turn") - 1).alias("pos"), "href", F.substring("f.title", 1, 240).alias("title"))


def completed(items: DataFrame, pages: DataFrame, key: str, source: str, url: str, body: str, least: int = 400, most: int = 20) -> DataFrame:
    """Items whose text is short get that of their page where it is longer; the first `most` such of each source, by key.

    pages: url, text. Adds completed. The rank counts only items that gain, so it is taken after the join.
    """
    found = pages.groupBy(F.col("url").alias("page_url")).agg(F.max_by("text", F.length("text")).alias("page_text"))
    rows = items.join(found, items[url] == found["page_url"], "left").withColumn("gain", (F.length(F.coalesce(body, F.lit(""))) < least) & (F.length("page_text") > F.length(F.coalesce(body, F.lit("")))))
    few = rows.where("gain").select(key, F.row_number().over(Window.partitionBy(source).orderBy(key)).alias("turn")).where(F.col("turn") <= most).select(key, F.lit(True).alias("completed"))
    rows = rows.drop("gain", "page_url").join(few, key, "left").withColumn("completed", F.coalesce("completed", F.lit(False)))
    return rows.withColumn(body, F.when(F.col("completed"), F.col("page_text")).otherwise(F.col(body))).drop("page_text")


def preview_images(html: Column, most: int = 8) -> Column:
    """og:image, twitter:image, then img sources; distinct, without data and icon addresses, at most `most`."""
    meta = [F.regexp_extract_all(html, F.lit(rf"""(?i)<meta[^>]*(?:property|name)=["']{n}:image["'][^>]*content=["']([^"']+)["']"""), 1) for n in ("og", "twitter")]
    plain = F.transform(text.image_refs(html), lambda r: r["src"])
    return F.slice(F.array_distinct(F.filter(F.concat(*meta, plain), lambda u: ~F.lower(u).rlike(r"^data:|favicon|sprite|\.svg$"))), 1, most)


# Addresses of pictures that are none of the article's.
SKIPPED_PICTURES = r"(?i)(logo|sprite|pixel|tracking|1x1|spacer|blank\.gif|placeholder|default[-_]?(og|share)|avatar|icon[-_])"
LEAST_SIDE = 64


def joined(base: Column, ref: Column) -> Column:
    """A reference as a whole address: as it is, with the scheme of the base, from its root, or beside its path; empty without a base."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(?:/.*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return F.when(ref.startswith("//"), F.concat(F.lit("https:"), ref)).when(F.lower(ref).startswith("http"), ref).when(root == "", "").when(ref.startswith("/"), F.concat(root, ref)).otherwise(F.concat(folder, ref))


def preview_pictures(html: Column, base: Column, most: int = 8) -> Column:
    """Addresses of an article's pictures: of its meta tags (og, then twitter), then of images whose stated sides are not below LEAST_SIDE; whole, distinct, without icons and drawn ones, at most `most`."""
    def meta(name: str) -> Column:
        tags = F.regexp_extract_all(html, F.lit(r"(?is)(<meta\b[^>]*>)"), 1)
        own = F.filter(tags, lambda t: t.rlike(rf"""(?is)\b(?:property|name)\s*=\s*["']{name}["']"""))
        return F.transform(own, lambda t: F.regexp_extract(t, r"""(?is)\bcontent\s*=\s*["']([^"']*)["']""", 1))

    def side(t: Column, name: str) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(t, rf"""(?is)\b{name}\s*=\s*["']?([0-9]+)""", 1), F.lit("")).try_cast("int"), F.lit(0))

    images = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)(<img\b[^>]*>)"), 1), lambda t: ~((side(t, "width") > 0) & (side(t, "width") < LEAST_SIDE)) & ~((side(t, "height") > 0) & (side(t, "height") < LEAST_SIDE)))
    plain = F.transform(images, lambda t: F.coalesce(*[F.nullif(F.regexp_extract(t, rf"""(?is)\s{n}\s*=\s*["']([^"']*)["']""", 1), F.lit("")) for n in ("src", "data-src", "data-lazy-src")], F.lit("")))
    every = F.transform(F.concat(meta("og:image"), meta("twitter:image"), meta("twitter:image:src"), meta("og:image:url"), plain), lambda u: F.trim(u))
    whole = F.transform(F.filter(every, lambda u: (u != "") & ~u.startswith("data:")), lambda u: joined(base, u))
    return F.slice(F.array_distinct(F.filter(whole, lambda u: F.lower(u).startswith("http") & ~u.rlike(SKIPPED_PICTURES) & ~F.lower(u).endswith(".svg"))), 1, most)
