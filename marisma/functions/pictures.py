"""Addresses and pictures: which may be shown, stored or learned from, as Column expressions. Null counts as empty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from marisma.functions import urls

# Hosts that are trusted with all below them, hosts that never are, parts of invented addresses.
ALLOWED = (
    "woah.org", "oie.int", "fao.org", "who.int", "paho.org", "gob.mx", "cdc.gov", "usda.gov", "nih.gov", "un.org", "europa.eu", "youtube.com", "youtu.be", "openalex.org", "pubmed.ncbi.nlm.nih.gov", "openstreetmap.org", "senasica.gob.mx", "wahis.woah.org",
)
BLOCKED = ("example.invalid", "example.com", "example.org", "www.example.com", "www.example.org", "www.example.invalid", "social.local", "localhost", "127.0.0.1", "0.0.0.0")
FAKE = ("example.invalid", "example.com", "social.local", "rumor-vacuna", "rumor vacuna")
# Classes of pictures, parts of names of invented ones, endings that can be learned from, from which confidence on.
CLASSES = ("OFFICIAL_DOCUMENT", "NEWS_SCREENSHOT", "SOCIAL_MEDIA", "MEME", "INFOGRAPHIC", "ANIMAL_HEALTH_CONTENT", "PHOTOGRAPH", "POTENTIALLY_MANIPULATED")
SKIP = ("fb_", "demo_seed_", "ph_", "corpus_", "casos", "cnn/dataset", "models/cnn", "cnn_synth", "inapp:")
ENDINGS = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".gif")
LEAST_CONFIDENCE, LEAST_SIDE = 0.5, 64


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def _any(x: Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(x, F.lit(p))
    return out


def hostname(url: Column) -> Column:
    """Host of an address in lower case, without user, port and dots at the end."""
    return F.rtrim(F.lower(F.regexp_extract(F.trim(_text(url)), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("."))


def is_fake(url: Column) -> Column:
    """An address that was made up: it holds a marked part, or its host is a blocked one or under one of the first two."""
    host = hostname(url)
    return (F.trim(_text(url)) != "") & (_any(F.lower(_text(url)), FAKE) | host.isin(*BLOCKED) | host.endswith(".example.com") | host.endswith(".example.invalid"))


def host_allowed(host: Column) -> Column:
    return (host != "") & ~host.isin(*BLOCKED) & urls.under(host, ALLOWED)


def _web(url: Column) -> Column:
    return F.lower(F.trim(_text(url))).rlike("^https?://")


def public_url(url: Column) -> Column:
    """The address where it is of a trusted host and not made up, else empty."""
    return F.when(~is_fake(url) & _web(url) & host_allowed(hostname(url)), F.trim(url)).otherwise("")


def stored_url(url: Column) -> Column:
    """What is stored of an article's address: web addresses of hosts that are not blocked, and those inside the application; else empty."""
    raw, host = F.trim(_text(url)), hostname(url)
    web = _web(url) & (host != "") & ~host.isin(*BLOCKED)
    return F.when(is_fake(url), "").when(raw.startswith("inapp:") | web, raw).otherwise("")


def _slashes(x: Column) -> Column:
    return F.lower(F.replace(_text(x), F.lit("\\"), F.lit("/")))


def _name(x: Column) -> Column:
    return F.regexp_extract(_slashes(x), r"([^/]*)/*$", 1)


def is_news_picture(image_id: Column, storage: Column, source: Column, mime: Column) -> Column:
    """A real photograph or still: not a drawn one, not of the training set or a seed, of a known kind; with a web source, or an id and a place."""
    key, src, kind = _slashes(storage), _slashes(source), F.lower(_text(mime))
    name, other = _name(storage), _name(source)
    blob = F.concat_ws(" ", key, src)
    drawn = name.startswith("ph_") | name.endswith(".svg") | F.contains(kind, F.lit("svg"))
    extra = F.concat_ws(" ", name, other)
    seed = extra.startswith("corpus_") | F.contains(extra, F.lit(" corpus_")) | extra.startswith("fb_") | F.contains(extra, F.lit(" fb_")) | F.contains(extra, F.lit("demo_seed_"))
    strange = (kind != "") & ~_any(kind, ("jpeg", "jpg", "png", "webp", "svg"))
    return F.when(drawn | _any(blob, ("models/cnn", "cnn/dataset")) | seed | strange, False).otherwise(src.rlike("^https?://") | ((_text(image_id) != "") & (_text(storage) != "")))


def is_generic(path: Column, mime: Column) -> Column:
    """Nothing to show as a preview: empty, drawn, of the training set or a seed."""
    raw, name = _slashes(path), _name(path)
    blob = F.concat_ws(" ", raw, F.lower(_text(mime)))
    return (F.trim(raw) == "") | name.startswith("ph_") | name.endswith(".svg") | _any(blob, ("image/svg", "models/cnn", "cnn/dataset", "/fb_", "/corpus_", "demo_seed")) | name.startswith("fb_") | name.startswith("corpus_")


def is_placeholder(storage: Column, source: Column, synthetic: Column, width: Column, height: Column) -> Column:
    """Not to be learned from: a marked name, made by a program, without a web source, or tiny on both sides."""
    src = F.lower(F.trim(_text(source)))
    tiny = F.coalesce((width > 0) & (height > 0) & (width <= LEAST_SIDE) & (height <= LEAST_SIDE), F.lit(False))
    blob = F.concat_ws(" ", _name(storage), _slashes(storage), _slashes(source))
    return _any(blob, SKIP) | F.coalesce(synthetic, F.lit(False)) | src.startswith("data:") | ~src.rlike("^https?://") | tiny


def can_teach(kind: Column, confidence: Column, storage: Column, source: Column, synthetic: Column, width: Column, height: Column) -> Column:
    """Whether a picture goes to the training set: of a known class with enough confidence, no placeholder, of a known ending."""
    ending = F.lower(F.regexp_extract(_name(storage), r"[^.](\.[^.]*)$", 1))
    return F.trim(_text(kind)).isin(*CLASSES) & (F.coalesce(confidence.try_cast("double"), F.lit(0.0)) >= LEAST_CONFIDENCE) & (_text(storage) != "") & ~is_placeholder(storage, source, synthetic, width, height) & ending.isin(*ENDINGS)


def hex_distance(a: Column, b: Column) -> Column:
    """Digits in which two hex texts of equal length differ; null where one is missing or lengths differ."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x != y, 1).otherwise(0))
    return F.when((F.length(a) == F.length(b)) & (a != ""), F.aggregate(pairs, F.lit(0), lambda s, x: s + x))


def is_displayable(image_id: Column, storage: Column, source: Column, mime: Column) -> Column:
    """A picture of an article that can be shown beside it."""
    name = _name(storage)
    return ~name.startswith("ph_") & ~name.endswith(".svg") & is_news_picture(image_id, storage, source, mime)


def is_purged(storage: Column, width: Column, height: Column) -> Column:
    """What goes from the training set: files of a known ending whose name tells an invented picture, and tiny ones."""
    name = _name(storage)
    ending = F.regexp_extract(name, r"[^.](\.[^.]*)$", 1)
    tiny = F.coalesce((width > 0) & (height > 0) & (width <= LEAST_SIDE) & (height <= LEAST_SIDE), F.lit(False)) & (ending == ".png")
    return ending.isin(*ENDINGS) & (_any(name, ("fb_", "demo_seed_", "corpus_", "casos", "ph_")) | tiny)
