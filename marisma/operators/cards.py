"""Evidence cards and reviews: what is shown of them and how they change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marisma.functions import urls


def capped(cards: DataFrame, owner: str, order: str, url: str, most: int = 4, usable: Column | None = None) -> DataFrame:
    """At most `most` cards of an owner, in order, one for each address and one for each host; with usable, cards that are not usable give way to others of their host.

    The first (usable) card of a host is the only one that can stay, so hosts are counted out by an aggregate before cards are ranked.
    """
    rows = cards.withColumns({"host": urls.host(F.col(url)), "canonical": urls.canonical(F.col(url))}).where("host <> ''")
    rows = rows if usable is None else rows.where(usable)
    first = rows.groupBy(owner, "host").agg(F.min(F.struct(order, *[c for c in rows.columns if c not in (owner, order, "host")])).alias("r"))
    first = first.select(owner, "host", "r.*")
    turn = F.row_number().over(Window.partitionBy(owner).orderBy(order))
    return first.withColumn("turn", turn).where(F.col("turn") <= most).drop("canonical")


# Why a narrative has its state, and what is said where an article speaks of duties.
WHY = {
    "contradicha": "La evidencia oficial choca con la afirmación principal.", "parcial": "Una parte encaja con las fichas; otra sigue abierta.", "respaldada": "Las fichas alinean con la afirmación.",
    "prioridad_investigacion": "Hay acusación de ocultamiento en modo afirmación y una estructura de relato. Cola humana; no es una sentencia de intención maliciosa.",
    "potencialmente_engañosa": "Puede inducir una lectura incorrecta. Hay que revisar omisiones y contexto.", "no_verificable": "No hay evidencia bastante para confirmar ni descartar.",
}
DUTY = "La nota habla de obligación de reportar. Hay que contrastar plazos y autoridad (WOAH / SENASICA). El módulo no cita un artículo legal automático."
OPEN_LABELS = ("", "unknown", "sin verificar", "insuficiente")


def contrast(articles: DataFrame, key: str, claims: DataFrame, structures: Column, hidden: Column, most: int = 5) -> DataFrame:
    """What an article says beside what is known of it: key, claim (its first one, else the title), contradicted and open (ids of the first `most` claims of each), duty, code, why.

    articles has key, title, text; claims has key, turn, claim, claim_id, label. An article's claims are few (their extraction keeps eight), so they are an array.
    """
    from marisma.operators import stories

    rows = claims.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "claim", "claim_id", F.lower(F.coalesce("label", F.lit(""))).alias("low")))).alias("cs"))
    none = F.array().cast(rows.schema["cs"].dataType)
    out = articles.join(rows, key, "left").withColumn("cs", F.coalesce("cs", none))
    ids = lambda test: F.slice(F.transform(F.filter("cs", test), lambda c: c["claim_id"]), 1, most)
    blob = F.lower(F.concat_ws(" ", "title", "text"))
    code = stories.narrative(F.transform("cs", lambda c: c["low"]), structures, hidden)
    out = out.withColumn("code", code)
    why = F.element_at(F.create_map(*[F.lit(x) for p in WHY.items() for x in p]), F.col("code"))
    return out.select(
        key, F.substring(F.coalesce(F.get("cs", F.lit(0))["claim"], F.col("title"), F.lit("")), 1, 500).alias("claim"), ids(lambda c: F.contains(c["low"], F.lit("contrad"))).alias("contradicted"), ids(lambda c: c["low"].isin(*OPEN_LABELS)).alias("open"),
        F.when(F.contains(blob, F.lit("oblig")) | F.contains(blob, F.lit("plazo")), DUTY).alias("duty"), "code", why.alias("why"),
    )


# What a decision makes of an article: verdict, risk (none: as it was), rule. The third one leaves the alert open.
DECISIONS = (("validado", "RESPALDADO", 22, "hitl_validado"), ("descartado", "CONTRADICHO", 82, "hitl_descartado"), ("modificado", "REVISIÓN HUMANA", None, "hitl_modificado"))
OPEN = "modificado"


def review_states(articles: DataFrame, reviews: DataFrame, key: str, order: str, label: str, reason: str) -> DataFrame:
    """Articles (key, verdict, risk) as reviewers leave them: adds status, rule, hitl_label, hitl_reason, decisions and closed.

    Labels count trimmed and in lower case. "validado" and "descartado" close the alert with a verdict and a risk of their own; "modificado" asks for
    a human verdict and leaves the alert pending and the risk as it is; any other label closes the alert and changes nothing else. So the
    verdict is that of the last label with one, the risk that of the last closing one, and the alert is pending where the last label left it open. closed counts
    the decisions that are kept for training. An article without a review keeps all, its status is null.
    """
    rows = reviews.withColumn("_label", F.lower(F.trim(F.coalesce(F.col(label), F.lit("")))))
    effect = {name: (verdict, risk, rule) for name, verdict, risk, rule in DECISIONS}

    def last(value, labels=None):
        known = F.lit(True) if labels is None else F.col("_label").isin(*labels)
        return F.max_by(value, F.when(known, F.col(order)))

    got = rows.groupBy(key).agg(
        last(F.col("_label")).alias("last"), last(F.struct("_label", F.col(reason).alias("reason")), effect).alias("verdict_of"), last(F.col("_label"), [n for n, e in effect.items() if e[1] is not None]).alias("risk_of"),
        F.count(F.lit(1)).alias("decisions"), F.count_if(F.col("_label") != OPEN).alias("closed"),
    )

    def of(x, i, otherwise):
        for name, e in effect.items():
            if e[i] is not None:
                otherwise = F.when(x == name, F.lit(e[i])).otherwise(otherwise)
        return otherwise

    named = F.col("verdict_of")["_label"]
    return articles.join(got, key, "left").select(
        *[c for c in articles.columns if c not in ("verdict", "risk")], of(named, 0, F.col("verdict")).alias("verdict"), of(F.col("risk_of"), 1, F.col("risk")).alias("risk"),
        F.when(F.col("last") == OPEN, "pending_review").when(F.col("last").isNotNull(), "reviewed").alias("status"), of(named, 2, F.lit(None).cast("string")).alias("rule"), named.alias("hitl_label"), F.col("verdict_of")["reason"].alias("hitl_reason"),
        F.coalesce("decisions", F.lit(0)).alias("decisions"), F.coalesce("closed", F.lit(0)).alias("closed"),
    )


def running_failures(rows: DataFrame, key: str, order: str, ok: str) -> DataFrame:
    """Adds failures: how many runs in a row have failed up to each run; a good run sets it to 0."""
    w = Window.partitionBy(key).orderBy(order)
    rows = rows.withColumn("good", F.sum(F.when(F.col(ok), 1).otherwise(0)).over(w))
    return rows.withColumn("failures", F.sum(F.when(F.col(ok), 0).otherwise(1)).over(Window.partitionBy(key, "good").orderBy(order))).drop("good")
