"""JSON in text columns: objects out of replies, merged objects, maps of scores. Text that is no JSON counts as none."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_object(v: Column) -> Column:
    """Whether a variant is an object; false for null."""
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def parsed(x: Column) -> Column:
    """The object that a text is, as a variant; null for anything else."""
    v = F.try_parse_json(x)
    return F.when(is_object(v), v)


def salvaged(x: Column) -> Column:
    """The object in a reply, as a variant: what stands in a code fence, else the whole text; if that is no JSON, what stands from its first { to its last }.

    JSON that is no object is none, and is not searched further.
    """
    bare = F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s+|\s+$", "")
    fence = F.regexp_replace(F.regexp_extract(bare, r"```(?:json)?\s*([\s\S]*?)```", 1), r"^\s+|\s+$", "")
    text = F.when(bare.rlike(r"```[\s\S]*?```"), fence).otherwise(bare)
    whole = F.try_parse_json(text)
    return F.when(whole.isNotNull(), F.when(is_object(whole), whole)).otherwise(parsed(F.nullif(F.regexp_extract(text, r"\{[\s\S]*\}", 0), F.lit(""))))


def field(v: Column, path: str, kind: str = "string") -> Column:
    """A value of a variant by its path ($.a[0].b); null where it is absent or of another kind."""
    return F.try_variant_get(v, path, kind)


def merged(*objects: Column) -> Column:
    """The fields of texts that are objects, as a map of variants; of one name the last text wins, as a whole and with null too."""
    none = F.create_map().cast("map<string, variant>")
    maps = [F.coalesce(parsed(x).cast("map<string, variant>"), none) for x in objects]

    def over(old: Column, new: Column) -> Column:
        return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)

    return reduce(over, maps)


def promoted(column: Column, extra: Column, name: str) -> Column:
    """A column, or where it is null or empty the field of that name of a text."""
    return F.coalesce(F.nullif(column, F.lit("")), F.nullif(field(parsed(extra), f"$.{name}"), F.lit("")))


def filled_scores(text: Column, label: Column, confidence: Column, classes: Sequence[str]) -> Column:
    """Scores of classes: those of a text that is an object with any, else what a label and its confidence leave to the others, to four places."""
    own = parsed(text).cast("map<string, double>")
    rest = F.greatest(F.lit(0.05), 1.0 - F.greatest(confidence, F.lit(0.4)))
    other = F.round(rest / max(1, len(classes) - 1), 4)
    cells = [c for name in classes for c in (F.lit(name), F.when(label == name, F.round(F.greatest(confidence, F.lit(0.42)), 4)).otherwise(other))]
    return F.when(F.size(own) > 0, own).otherwise(F.create_map(*cells))


def best(scores: Column) -> Column:
    """struct(label, score) of the highest score, of equal ones the first in alphabet; null without any."""
    top = F.array_sort(F.transform(F.filter(F.map_entries(scores), lambda e: e["value"].isNotNull()), lambda e: F.struct((-e["value"]).alias("m"), e["key"].alias("label"))))
    return F.when(F.size(top) > 0, F.struct(top[0]["label"].alias("label"), (-top[0]["m"]).alias("score")))
