"""Risk, verdicts and other scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the score: weights in the order they are summed.
WEIGHTS = {"evidence_contradiction": 0.28, "source_reliability": 0.22, "image_reuse": 0.18, "claim_severity": 0.18, "narrative_growth": 0.08, "visual_anomaly": 0.06}
AUTHORITY = {"A": 10, "B": 25, "C": 45, "D": 60, "E": 75, "F": 90}
VISUAL = {"POTENTIALLY_MANIPULATED": 92, "MEME": 72, "SOCIAL_MEDIA": 48, "NEWS_SCREENSHOT": 22, "INFOGRAPHIC": 28, "PHOTOGRAPH": 8, "OFFICIAL_DOCUMENT": 4, "ANIMAL_HEALTH_CONTENT": 12}
REVIEWED = {"validado": ("RESPALDADO", 22), "descartado": ("CONTRADICHO", 82)}
NEEDS_REVIEW = ("CONTRADICHO", "POSIBLEMENTE ENGAÑOSO", "REVISIÓN HUMANA")


def clip(x: Column) -> Column:
    """Between 0 and 100; null counts as 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(x.cast("double"), F.lit(0.0))))


def cases(key: Column, values: dict, default) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def weighted_risk(parts: dict[str, Column]) -> Column:
    """Sum of clipped parts by their weights, in their fixed order, rounded half to even."""
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + clip(parts[name]) * F.lit(weight)
    return F.bround(total, 0).cast("bigint")


def verdict(score: Column, nli: Column, human: Column, low_confidence: Column) -> Column:
    return (
        F.when(human | low_confidence, "REVISIÓN HUMANA").when((nli == "Contradicted") | (score >= 75), "CONTRADICHO").when((nli == "Supported") & (score < 35), "RESPALDADO")
        .when(score >= 55, "POSIBLEMENTE ENGAÑOSO").when(nli == "Supported", "RESPALDADO").otherwise("INSUFICIENTE")
    )


def rule(score: Column, nli: Column, human: Column, low_confidence: Column, cut: Column, numeric: Column) -> Column:
    """Which step of the verdict decided."""
    named = verdict(score, nli, human, low_confidence)
    review = F.when(numeric >= 70, "cifra_parte").when(cut >= 70, "discrepancia").when(low_confidence, "baja_confianza").otherwise("human")
    return (
        F.when(named == "REVISIÓN HUMANA", review).when(nli == "Contradicted", "nli_contradicted").when(score >= 75, "score_high").when(named == "RESPALDADO", "supported_low_risk")
        .when(named == "POSIBLEMENTE ENGAÑOSO", "score_mid").otherwise("insufficient_evidence")
    )


def needs_alert(score: Column, named: Column, threshold: int = 55) -> Column:
    return (score >= threshold) | named.isin(*NEEDS_REVIEW)


def growth_score(growth: Column) -> Column:
    return F.when(F.coalesce(growth, F.lit(0.0)) <= 0, 0.0).otherwise(clip(growth * 0.65 + 18.0))


def visual_score(kind: Column, confidence: Column) -> Column:
    base = cases(F.upper(kind), VISUAL, 0).cast("double")
    share = F.when(confidence > 1, confidence / 100.0).otherwise(confidence)
    return clip(base * F.when(confidence.isNull(), 1.0).otherwise(F.greatest(F.lit(0.45), F.least(F.lit(1.0), share))))


def numeric_discrepancy(a: Column, b: Column) -> Column:
    """How far two counts differ: 86, 62 or 0."""
    gap, ratio = F.abs(a - b), F.greatest(a, b) / F.greatest(F.least(a, b), F.lit(1))
    return F.when((ratio >= 5) & (gap >= 20), 86).when((ratio >= 2) & (gap >= 10), 62).otherwise(0)


def vote(supported: Column, contradicted: Column, n: Column) -> Column:
    """struct(label, confidence) of a claim from its evidence."""
    def of(label: str, confidence: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), F.round(confidence, 3).alias("confidence"))

    return (
        F.when(n == 0, of("Unknown", F.lit(0.0)))
        .when((contradicted > supported) & (contradicted >= 1), of("Contradicted", F.least(F.lit(0.95), contradicted * 0.15 + 0.5)))
        .when((supported > contradicted) & (supported >= 2), of("Supported", F.least(F.lit(0.9), supported * 0.12 + 0.45)))
        .when((supported >= 1) & (contradicted == 0), of("Supported", F.lit(0.62)))
        .otherwise(of("Unknown", F.lit(0.35)))
    )


def pair_force(n: Column, same_sentence: Column) -> Column:
    base = F.when(n >= 40, 5).when(n >= 20, 4).when(n >= 8, 3).when(n >= 3, 2).otherwise(1)
    return F.when(same_sentence, F.least(F.lit(5), base + 1)).otherwise(base)


def contrast_level(evidence: Column, official: Column, judged: Column, days: Column) -> Column:
    base = (
        F.when(evidence == 0, 0).when((judged == 0) & (official == 0), 1).when((official >= 1) & (evidence < 3), 2)
        .when((official >= 1) & (evidence >= 3), 3).otherwise(3)
    )
    return F.when((official >= 2) & (days >= 5) & (evidence >= 5), 5).otherwise(base)


def priority(volume: Column, growth: Column, countries: Column, hidden: Column, human: Column) -> Column:
    return (
        F.when((volume >= 25) & (growth >= 150) & (countries >= 2) & hidden, "critica").when((volume >= 15) & (growth >= 80) & (hidden | human), "alta")
        .when((volume >= 8) & ((growth >= 40) | hidden), "media").otherwise("baja")
    )
