"""Claims of articles, the passage of a bulletin that fits one, and their contrast."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marisma.functions import facts, hashing, text


def claims(docs: DataFrame, key: str, body: Column, diseases: Column, bodies: Mapping[str, str], countries: Mapping[str, str], animals: Mapping[str, str], shortest: int = 20, most: int | None = 8) -> DataFrame:
    """Sentences that claim something, in order of kind and place, the first `most` distinct ones of each row (None: all); where there are none, its first 240 characters.

    diseases: ids found in the whole article. Returns key, turn, claim, kind, claim_id, subject, predicate, object, location, animal, verifiable.
    """
    rows = docs.select(F.col(key), body.alias("body"), diseases.alias("diseases"))
    kind = F.lit(None).cast("int")
    for i, pattern in reversed(list(enumerate(facts.CLAIM_KINDS.values()))):
        kind = F.when(F.col("low").rlike(pattern), i).otherwise(kind)
    # the first characters are a last row beside the sentences, so that these are read once
    whole = F.when(F.trim("body") != "", F.trim(F.substring("body", 1, 240)))
    cell = lambda i, s, bare: F.struct(i.cast("int").alias("pos"), s.alias("s"), F.lower(s).alias("low"), F.lit(bare).alias("bare"))
    sentences = F.transform(F.coalesce(text.ended(F.col("body")), F.array().cast("array<string>")), lambda s, i: cell(i, s, False))
    found = rows.select(key, "diseases", F.explode(F.concat(sentences, F.array(cell(F.lit(0), whole, True)))).alias("r")).select(key, "diseases", "r.*")
    # few sentences claim anything: the others go before patterns are tried
    found = found.where(F.col("bare") | ((F.length("s") >= shortest) & facts.claimed(F.col("low"))))
    found = text.once(found, kind=F.when(F.col("bare"), len(facts.CLAIM_KINDS)).otherwise(kind)).where(F.when(F.col("bare"), F.col("s").isNotNull()).otherwise(F.col("kind").isNotNull()))
    # a sentence that stands twice counts where it stands first
    found = found.groupBy(key, "bare", F.col("s").alias("claim")).agg(F.min(F.struct("kind", "pos")).alias("at"), F.any_value("diseases").alias("diseases"), F.count(F.lit(1)).alias("n"))
    turn, alone = F.row_number().over(Window.partitionBy(key).orderBy("at")), F.min("bare").over(Window.partitionBy(key))
    found = found.withColumns({"turn": turn, "alone": alone}).where(F.when(F.col("bare"), F.col("alone")).otherwise(F.lit(True) if most is None else F.col("turn") <= most))
    names = F.array(*[F.lit(k) for k in facts.CLAIM_KINDS], F.lit(""))
    times = F.when(F.col("bare"), F.array_repeat(F.lit(1), F.col("n").cast("int"))).otherwise(F.array("turn"))
    out = found.select(key, F.explode(times).alias("turn"), "claim", F.element_at(names, F.col("at.kind") + 1).alias("kind"), "diseases")
    own = facts.canonical(F.lower("claim"), {facts.DISEASE_IDS[k]: v for k, v in facts.DISEASES.items()})
    body_name = facts.first_named(F.col("claim"), bodies)
    subject = F.when(body_name != "", body_name).when(F.size(own) > 0, F.array_min(own)).otherwise(F.substring(F.substring_index(F.trim("claim"), " ", 1), 1, 40))
    out = text.once(out, subject=subject).withColumn("predicate", text.predicate(F.col("claim")))
    without = F.regexp_replace("claim", F.concat(F.lit("(?i)\\Q"), "subject", F.lit("\\E")), F.lit(" "))
    without = F.regexp_replace(without, F.concat(F.lit("(?i)\\Q"), "predicate", F.lit("\\E")), F.lit(" "))
    verifiable = (F.size("diseases") > 0) | F.col("claim").rlike("[0-9]") | F.col("subject").isin(*set(bodies.values())) | F.col("kind").isin(*facts.CHECKABLE)
    return out.select(
        key, "turn", "claim", "kind", F.substring(hashing.sha(F.substring("claim", 1, 200)), 1, 32).alias("claim_id"), "subject", "predicate", F.substring(text.collapse(without), 1, 240).alias("object"),
        facts.first_named(F.col("claim"), countries).alias("location"), facts.first_named(F.col("claim"), animals).alias("animal"), verifiable.alias("verifiable"),
    )


#: What a claim and a sentence may share, under one tree of terms; the first letter tells the kind.
_SHARED = {f"{kind}:{name}": needles for kind, named in (("d", facts.DISEASES), ("p", facts.PLACES), ("a", facts.ANIMALS)) for name, needles in named.items()}


def _weighed(rows: DataFrame, claim: str, body: str, shortest: int, most: int) -> DataFrame:
    """rows with the paragraph of body that fits claim best, and its score; both null where none does. See paragraphs()."""
    low, flat = F.lower(F.coalesce(F.col(claim), F.lit(""))), text.collapse(F.coalesce(F.col(body), F.lit("")))
    own = text.once(rows, _low=F.regexp_replace(low, r"\s+", " "), _own=text.tokens(low, (*facts.STOP, *facts.ANCHORS)), _flat=flat)
    cut = F.filter(F.transform(F.split("_flat", r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: (F.length(s) >= shortest) & facts.usable(s))
    own = text.once(own, _names=facts.canonical(F.col("_low"), _SHARED), _new=facts.any_of(F.col("_low"), facts.NOVELTY), _parts=F.when(F.length("_flat") >= shortest, cut))

    def cell(s: Column) -> Column:
        return F.struct(F.array_intersect("_names", facts.canonical(F.lower(s), _SHARED)).alias("names"), (F.col("_new") & facts.any_of(F.lower(s), facts.NOVELTY)).alias("new"), F.array_intersect("_own", text.tokens(s)).alias("own"))

    own = text.once(own, _cells=F.transform("_parts", cell))
    nothing = F.struct(F.array().cast("array<string>").alias("names"), F.lit(False).alias("new"), F.array().cast("array<string>").alias("own"))
    after = F.concat(F.slice("_cells", 2, F.greatest(F.size("_cells"), F.lit(1))), F.array(nothing))

    def weigh(a: Column, b: Column) -> Column:
        both = F.array_union(a["names"], b["names"])
        score = 2 * F.size(F.filter(both, lambda n: n.startswith("d:"))) + 3 * F.size(F.filter(both, lambda n: ~n.startswith("d:"))) + F.when(a["new"] | b["new"], 2).otherwise(0)
        return F.struct(score.alias("score"), F.size(F.array_union(a["own"], b["own"])).alias("shared"))

    windows = F.filter(F.transform(F.zip_with("_cells", after, weigh), lambda w, i: F.struct(w["score"].alias("score"), (-i).alias("m"), w["shared"].alias("shared"))), lambda w: (w["score"] > 0) & ((w["shared"] >= 2) | (w["score"] >= 3)))
    best = text.once(own, _b=F.when(F.size("_cells") > 0, F.array_max(windows)))
    window = F.trim(F.concat_ws(" ", F.get("_parts", -F.col("_b.m")), F.get("_parts", 1 - F.col("_b.m"))))
    return best.select(*[F.col(f"`{c}`") for c in rows.columns], F.when(F.col("_b").isNotNull(), F.substring(window, 1, most)).alias("paragraph"), F.col("_b.score").alias("score"))


def paragraphs(rows: DataFrame, keys: Sequence[str], claim: str, body: str, shortest: int = 40, most: int = 700) -> DataFrame:
    """For each row the one or two sentences of body that share most facts with claim, the first of equals: keys, paragraph, score. Rows without any are left out.

    A shared disease counts 2, place and animal 3, novelty 2; two tokens that are no disease's must be shared, or a score of 3 be reached.

    Each sentence is read once: what it shares with the claim is an array, and a window is the union of two neighbours, since no term reaches beyond the end of a
    sentence. All windows of a row are weighed inside it, so nothing is exchanged and no row is copied for a sentence.
    """
    return _weighed(rows.select(*keys, claim, body), claim, body, shortest, most).where("score is not null").select(*keys, "paragraph", "score")


def contrast(claims: DataFrame, evidence: DataFrame, peers: DataFrame, key: str, most_peers: int = 6) -> DataFrame:
    """What the best bulletin says of each claim, with the articles of the press that agree.

    claims: key, claim; evidence: key, snippet, title, n (its order); peers: key, title, peer. A bulletin of less than 40 characters is none. It ranks by
    hit (30) or partial (15), its 8 points for being official, and the score of its paragraph; of equals the first counts. Returns key, status,
    stance, snippet, title, why, peers (number).
    """
    pairs = claims.select(key, "claim").join(evidence.where(F.length(F.trim("snippet")) >= 40), key)
    # each pair carries what is found in it, so that it is made once and meets nothing again
    pairs = _weighed(pairs, "claim", "snippet", 40, 700).drop("score").withColumn("use", F.coalesce("paragraph", F.trim("snippet"))).drop("paragraph")
    pairs = _weighed(pairs, "claim", "use", 40, 700).drop("paragraph").withColumnRenamed("score", "points")
    pairs = text.once(pairs, x=facts.extract(F.col("claim")), y=facts.extract(F.col("use")))
    pairs = text.once(pairs, c=facts.compare(F.col("x"), F.col("y"))).where("c.status <> 'none'")
    rank = F.when(F.col("c.status") == "hit", 30).otherwise(15) + 8 + F.coalesce("points", F.lit(0))
    best = pairs.groupBy(key).agg(F.min_by(F.struct("c", F.substring("use", 1, 900).alias("snippet"), "title"), F.struct(-rank, "n")).alias("b"))
    agree = peers.groupBy(key).agg(F.least(F.count(F.lit(1)), F.lit(most_peers)).alias("peers"))
    out = claims.select(key).join(best, key, "left").join(agree, key, "left").withColumn("peers", F.coalesce("peers", F.lit(0)).cast("long"))
    told = F.format_string("%d nota(s) de prensa del recorte coinciden", "peers")
    why = (
        F.when(F.col("b").isNotNull() & (F.col("b.c.status") == "partial") & (F.col("peers") > 0), F.concat("b.c.why", F.lit(" "), told, F.lit(" en el mismo hecho."))).when(F.col("b").isNotNull(), F.col("b.c.why"))
        .when(F.col("peers") > 0, F.concat(told, F.lit(" en estos hechos. No hay boletín oficial de este caso en el recorte."))).otherwise("No hay boletín oficial ni otras notas del recorte que afirmen, desmientan o contradigan estos hechos.")
    )
    status = F.coalesce("b.c.status", F.when(F.col("peers") > 0, "peer").otherwise("none"))
    return out.select(key, status.alias("status"), F.col("b.c.stance").alias("stance"), F.col("b.snippet").alias("snippet"), F.col("b.title").alias("title"), why.alias("why"), "peers")


def agreeing(claims: DataFrame, corpus: DataFrame, key: str, most: int = 8) -> DataFrame:
    """Titles of the corpus that report a claim's disease and its place or animal: key, title, peer (the smallest id of a title).

    claims: key, f (facts); corpus: peer, title, f. Titles that read the same are one, before anything is joined; claims and titles then meet
    by equality on (disease, place or animal), of each such fact the first `most` titles by alphabet, which is all that can stay of a claim.
    """
    norm = F.btrim(F.regexp_replace(F.lower("title"), "[^a-z0-9áéíóúñ]+", " "), F.lit(" "))
    titles = corpus.withColumn("norm", norm).where("norm <> ''").groupBy("norm").agg(F.min_by(F.struct("peer", "title", "f"), "peer").alias("t")).select("norm", "t.*")

    def facts_of(f: Column) -> Column:
        what = F.concat(F.transform(f["places"], lambda p: F.concat(F.lit("p:"), p)), F.transform(f["animals"], lambda a: F.concat(F.lit("a:"), a)))
        return F.flatten(F.transform(f["diseases"], lambda d: F.transform(what, lambda w: F.concat(d, F.lit("|"), w))))

    wanted = text.once(claims, w=facts_of(F.col("f"))).select(key, F.explode_outer("w").alias("fact")).where("fact is not null").distinct()
    offered = text.once(titles, w=facts_of(F.col("f"))).select("norm", "title", "peer", F.explode_outer("w").alias("fact")).where("fact is not null")
    turn = F.row_number().over(Window.partitionBy("fact").orderBy("norm"))
    offered = offered.withColumn("turn", turn).where(F.col("turn") <= most + 1).drop("turn")
    near = wanted.join(offered, "fact").where(F.col(key) != F.col("peer")).groupBy(key, "norm").agg(F.min(F.struct("peer", "title")).alias("t"))
    near = near.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy("norm"))).where(F.col("turn") <= most)
    return near.select(key, F.col("t.title").alias("title"), F.col("t.peer").alias("peer"))
