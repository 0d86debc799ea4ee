"""What an article reports, as Column expressions: diseases, places, animals, whether it is new; claims and what speaks for them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from marisma.functions import text, urls

#: Up to so many needles are cheaper to look for one by one than by a pattern of all.
FEW = 24
#: Letters of a word where facts are looked for.
LETTERS = "a-z0-9_áéíóúüñ"
# What each place, animal and disease is called, the most specific place first.
PLACES = {
    "Presidio": ("presidio",),
    "Jeff Davis": ("jeff davis", "jeffdavis"),
    "Texas": ("texas",),
    "Nuevo México": ("nuevo méxico", "new mexico", "nuevo mexico"),
    "Chiapas": ("chiapas",),
    "Guanajuato": ("guanajuato",),
    "Oaxaca": ("oaxaca",),
    "Chihuahua": ("chihuahua",),
    "Tamaulipas": ("tamaulipas",),
    "Veracruz": ("veracruz",),
    "México": ("méxico", "mexico"),
    "EE.UU.": ("estados unidos", "united states", "ee.uu", "eeuu", "u.s.", "usa"),
}
ANIMALS = {
    "caballo": ("equine", "horse", "horses", "caballo", "caballos", "yegua"),
    "bovino": ("calf", "calves", "bovine", "cattle", "ternero", "vaca", "vacuno", "bovino"),
    "perro": ("dog", "dogs", "perro", "perros"),
    "caprino": ("goat", "goats", "cabra"),
    "ovino": ("sheep", "oveja", "ovino"),
    "porcino": ("swine", "pig", "cerdo", "porcino"),
    "fauna silvestre": ("wildlife", "fauna", "silvestre", "lion", "leones", "monkey", "monos", "puma", "macaw", "pavo", "deer", "venado"),
    "aves": ("poultry", "aves", "chicken", "gallina"),
}
DISEASES = {
    "gusano barrenador": ("screwworm", "barrenador", "cochliomyia", "hominivorax", "miasis", "gusano", "nws"),
    "gripe aviar": ("h5n1", "h5n2", "hpai", "influenza", "aviar", "avian", "gripe"),
    "peste porcina": ("porcina", "swine", "csfv", "hog cholera"),
}
DISEASE_IDS = {"gusano barrenador": "gusano_barrenador", "gripe aviar": "gripe_aviar", "peste porcina": "fiebre_porcina_clasica"}
NOVELTY = ("first", "primer", "primera", "1st", "century", "siglo", "este siglo")
NOISE = ("vehcs", "pet travel", "take a pet", "bring a pet", "all submissions must", "accredited veterinarians", "javascript", "enable cookies")
# Words that say nothing of an event, words of diseases, and phrases of misinformation.
STOP = (
    "the", "and", "for", "that", "with", "from", "this", "are", "was", "were", "have", "has", "not", "but", "you", "all", "can", "una", "uno", "los", "las", "del", "por", "con", "para", "que", "como", "más", "mas", "sobre", "entre",
    "este", "esta", "hay", "son", "sus", "http", "https", "www", "org", "com", "html", "index", "page", "home", "sitio", "página", "noticia", "news", "article", "brote", "outbreak", "caso", "casos", "salud", "health", "animal",
    "animals", "enfermedad", "disease", "official", "oficial",
)
ANCHORS = ("h5n1", "h5n2", "hpai", "lpai", "influenza", "aviar", "avian", "gripe", "screwworm", "barrenador", "cochliomyia", "hominivorax", "miasis", "nws", "porcina", "swine", "csfv", "wahis", "senasica", "woah", "omsa", "aphis", "poultry", "aves", "corral", "ganado", "bioseguridad", "biosecurity")
MISINFORMATION = ("laboratorio", "arma biol", "creada artificial", "creado artificial", "autoridades ocultan", "ocultan el brote", "vacuna causa", "vacunas causan", "inventaron la enfermedad", "fake", "biolab", "bioweapon", "gain of function")
BODIES = ("woah", "omsa", "senasica", "who", "fao", "cdc", "aphis", "wahis")
# The kinds of sentences that are claims, in the order they are tried.
CLAIM_KINDS = {
    "casos": r"casos?\s+(?:confirmados?|activos?|reportados?)",
    "brote": r"brote|foco|rebrote|outbreak",
    "medida_oficial": r"senasica|cuarentena|sacrificio\s+sanitario|woah|omsa",
    "cifra": r"[0-9]+\s*(?:%|por\s+ciento|casos?|muertes?|animales?)",
    "propagacion": r"propagación|expansión|frontera|riesgo|spread",
    "control": r"vacuna|vacunación|erradicación|vaccine",
    "conspiracion": r"ocult[a-z0-9_áéíóúüñ]+|laboratorio|arma\s+biol|cread[oa]\s+artificial",
}
#: Parts one of which a lower-cased sentence of any kind holds; but for figures, which have a digit.
CLAIM_SIGNS = (
    "caso", "brote", "foco", "outbreak", "senasica", "cuarentena", "sacrificio", "woah", "omsa", "propagación", "expansión", "frontera", "riesgo", "spread", "vacuna", "erradicación", "vaccine", "ocult", "laboratorio", "arma", "cread",
)
CHECKABLE = ("casos", "cifra", "medida_oficial", "brote")


def strict(term: str) -> bool:
    """Whether a needle must stand as a word of its own; those with a space or a dot are found anywhere."""
    return " " not in term and "." not in term


def canonical(blob: Column, named: Mapping[str, Sequence[str]]) -> Column:
    """Names with a needle in the lower-cased text, in their order; null for null.

    Up to FEW needles are looked for as plain parts, and only one that is there has the letters beside it looked at, up to its first place as a word; more of them in one pass.
    """
    if sum(map(len, named.values())) > FEW:
        return _all_at_once(blob, named)

    def holds(b: Column, needle: str) -> Column:
        part = F.contains(b, F.lit(needle))
        return part & b.rlike(f"(?<![{LETTERS}]){text.quoted(needle)}(?![{LETTERS}])") if strict(needle) else part

    def names(b: Column) -> Column:
        tests = [reduce(or_, [holds(b, n.lower()) for n in needles]) for needles in named.values()]
        return F.array_compact(F.array(*[F.when(c, name) for c, name in zip(tests, named, strict=True)]))

    # the one-element array binds the text once for all needles
    return F.when(blob.isNotNull(), F.transform(F.array(blob), names)[0])


def _all_at_once(blob: Column, named: Mapping[str, Sequence[str]]) -> Column:
    """What canonical() tells, by one pattern of all needles."""
    names = list(named)
    numbers = []
    for own, letters in ((True, LETTERS), (False, None)):
        of = {t: i for i, name in enumerate(names) for t in named[name] if strict(t) == own}
        if of:
            table = {t: [of[s] for s in ts] for t, ts in text.implied(list(of), letters).items()}
            numbers.append(text.numbers_of(text.found_terms(blob, list(of), letters), table))
    both = numbers[0] if len(numbers) == 1 else F.array_sort(F.array_union(*numbers))
    return F.transform(both, lambda i: F.element_at(F.array(*[F.lit(n) for n in names]), i + 1))


def any_of(x: Column, needles: Sequence[str]) -> Column:
    """Whether x holds one of the needles, as a part."""
    return x.rlike("|".join(text.quoted(n) for n in needles))


def claimed(low: Column) -> Column:
    """Whether a lower-cased sentence may be of some kind of claim: plain parts and digits, which cost far less than the patterns."""
    return reduce(or_, [F.contains(low, F.lit(s)) for s in CLAIM_SIGNS]) | low.rlike("[0-9]")


def any_word(x: Column, needles: Sequence[str], letters: str = LETTERS) -> Column:
    """Whether x holds one of the needles as a word; those with a space or a dot anywhere."""
    own, parts = [n for n in needles if strict(n)], [n for n in needles if not strict(n)]
    out = x.rlike(f"(?<![{letters}])(?:{'|'.join(map(text.quoted, own))})(?![{letters}])") if own else F.lit(False)
    return out | any_of(x, parts) if parts else out


def extract(x: Column) -> Column:
    """struct(diseases, places, animals, novelty) of a text; nothing for null."""
    blob = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"\s+", " ")
    return F.struct(canonical(blob, DISEASES).alias("diseases"), canonical(blob, PLACES).alias("places"), canonical(blob, ANIMALS).alias("animals"), any_of(blob, NOVELTY).alias("novelty"))


def labels(f: Column) -> Column:
    """Facts as short labels: diseases, three places, two animals, and what is new."""
    return F.concat(f["diseases"], F.slice(f["places"], 1, 3), F.slice(f["animals"], 1, 2), F.when(f["novelty"], F.array(F.lit("primer caso"))).otherwise(F.array().cast("array<string>")))


def usable(x: Column) -> Column:
    """Whether a stretch of a page is text, not navigation."""
    low = F.lower(x)
    return ~any_of(low, NOISE) & ~F.contains(F.substring(low, 1, 50), F.lit("latest news"))


def compare(a: Column, b: Column) -> Column:
    """What facts b (of a bulletin) say of facts a (of a claim): struct(status, stance, why, places, animals)."""
    both = {k: F.array_intersect(a[k], b[k]) for k in ("diseases", "places", "animals")}
    places, animals = F.array_sort(both["places"]), F.array_sort(both["animals"])
    some = {k: F.size(v) > 0 for k, v in both.items()}
    missing_p, missing_a, extra_a = F.array_except(a["places"], b["places"]), F.array_except(a["animals"], b["animals"]), F.array_except(b["animals"], a["animals"])
    full = ((F.size(a["places"]) == 0) | some["places"]) & ((F.size(a["animals"]) == 0) | some["animals"])
    hit = full & (some["places"] | some["animals"] | (a["novelty"] & b["novelty"]))
    core = some["places"] | some["animals"]
    part = lambda c, x: F.when(c, x).otherwise("")
    hit_why = F.concat(F.lit("El boletín oficial afirma los mismos hechos (enfermedad"), part(some["places"], ", lugar"), part(some["animals"], ", animal"), F.lit(")."))
    partial_why = F.concat(
        F.lit("Coincide en la enfermedad"),
        part(some["places"], F.concat(F.lit("; y en "), F.array_join(places, ", "))),
        F.when(F.size(missing_a) > 0, F.concat(F.lit("; no menciona "), F.array_join(missing_a, ", "))).when(F.size(extra_a) > 0, F.concat(F.lit("; habla de "), F.array_join(extra_a, ", "), F.lit(", no de lo que dice la nota"))).otherwise(""),
        part(F.size(missing_p) > 0, F.concat(F.lit("; no sitúa el hecho en "), F.array_join(F.slice(missing_p, 1, 2), ", "))),
        F.lit("."),
    )
    status = F.when(~some["diseases"], "none").when(hit, "hit").when(core, "partial").otherwise("none")
    why = F.when(~some["diseases"], "El fragmento no habla de la misma enfermedad.").when(hit, hit_why).when(core, partial_why).otherwise("Nombra la enfermedad, pero no el lugar ni el animal de esta nota.")
    return F.struct(status.alias("status"), F.when(some["diseases"] & hit, "Supported").alias("stance"), why.alias("why"), places.alias("places"), animals.alias("animals"))


def stance(claim: Column, snippet: Column, url: Column) -> Column:
    """What a snippet says of a claim; unknown unless an official one shares enough of it or speaks against misinformation."""
    own, other = text.tokens(F.coalesce(claim, F.lit("")), STOP), text.tokens(F.coalesce(snippet, F.lit("")), STOP)
    shared = F.array_intersect(own, other)
    held = F.array_intersect(shared, F.array(*[F.lit(a) for a in ANCHORS]))
    low, official = F.lower(snippet), urls.under(urls.host(url), urls.OFFICIAL)
    false = any_of(F.lower(F.coalesce(claim, F.lit(""))), MISINFORMATION)
    against = false & (official | any_of(low, BODIES)) & ~any_of(low, MISINFORMATION)
    enough = official & (F.size(own) >= 5) & (F.size(shared) >= 6) & (F.size(held) >= 2) & (F.size(shared) - F.size(held) >= 2)
    return F.when(F.coalesce(F.trim(snippet), F.lit("")) == "", "Unknown").when(against, "Contradicted").when(enough, "Supported").otherwise("Unknown")


def first_named(x: Column, named: Mapping[str, str]) -> Column:
    """What the longest needle in x stands for; "" without any."""
    low, out = F.lower(x), F.lit("")
    for needle in sorted(named, key=len):
        out = F.when(F.contains(low, F.lit(needle)), named[needle]).otherwise(out)
    return out
