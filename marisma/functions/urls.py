"""Address functions as Column expressions. A null or malformed url has an empty host."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts of official bodies.
OFFICIAL = ("woah.org", "who.int", "fao.org", "cdc.gov", "gob.mx", "usda.gov", "aphis.usda.gov", "paho.org", "oie.int", "ecdc.europa.eu", "tahc.texas.gov", "canada.ca", "copeg.org", "senasa.gob.ar")


def host(url: Column) -> Column:
    """Lower-cased host without "www."."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host and path without the slashes at its end."""
    return F.concat(host(url), F.regexp_replace(path(url), "/+$", ""))


def under(name: Column, domains: Sequence[str]) -> Column:
    """Whether a host is one of the domains or below one."""
    out = F.lit(False)
    for d in domains:
        out = out | (name == d) | name.endswith("." + d)
    return out


def suffixes(name: Column) -> Column:
    """A host and all domains above it, longest first: an equality join on these finds what is under a domain."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def youtube_id(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?:youtu\.be/|[?&]v=|/embed/|/shorts/)([A-Za-z0-9_-]{11})", 1)


def public(url: Column) -> Column:
    """The trimmed url if it is http(s) with a host that has a dot, else null."""
    x = F.trim(url)
    return F.when(x.rlike(r"^https?://[^/?#]+\.[^/?#]+"), x)


def is_homepage(url: Column) -> Column:
    return (host(url) != "") & F.regexp_replace(path(url), r"/+$", "").rlike(r"^(/(index|home|inicio)(\.[a-z]+)?)?$")
