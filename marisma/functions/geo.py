"""Countries and places: fixed tables, and which of them a text is about, as Column expressions over found spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code, name, latitude, longitude of a country; the last two are no place on the map.
COUNTRIES = (
    ("MX", "México", 23.63, -102.55), ("US", "Estados Unidos", 39.83, -98.58), ("GT", "Guatemala", 15.78, -90.23), ("BZ", "Belice", 17.19, -88.50), ("HN", "Honduras", 15.20, -86.24), ("SV", "El Salvador", 13.79, -88.90), ("NI", "Nicaragua", 12.87, -85.21),
    ("CR", "Costa Rica", 9.75, -83.75), ("PA", "Panamá", 8.54, -80.78), ("CO", "Colombia", 4.57, -74.30), ("VE", "Venezuela", 6.42, -66.59), ("BR", "Brasil", -14.24, -51.93), ("AR", "Argentina", -38.42, -63.62), ("CL", "Chile", -35.68, -71.54),
    ("PE", "Perú", -9.19, -75.02), ("EC", "Ecuador", -1.83, -78.18), ("BO", "Bolivia", -16.29, -63.59), ("UY", "Uruguay", -32.52, -55.77), ("PY", "Paraguay", -23.44, -58.44), ("CU", "Cuba", 21.52, -77.78), ("DO", "República Dominicana", 18.74, -70.16),
    ("ES", "España", 40.46, -3.75), ("FR", "Francia", 46.23, 2.21), ("DE", "Alemania", 51.17, 10.45), ("GB", "Reino Unido", 55.38, -3.44), ("IT", "Italia", 41.87, 12.57), ("NL", "Países Bajos", 52.13, 5.29), ("CH", "Suiza", 46.82, 8.23),
    ("CN", "China", 35.86, 104.20), ("JP", "Japón", 36.20, 138.25), ("KR", "Corea del Sur", 35.91, 127.77), ("IN", "India", 20.59, 78.96), ("AU", "Australia", -25.27, 133.78), ("NZ", "Nueva Zelanda", -40.90, 174.89), ("ZA", "Sudáfrica", -30.56, 22.94),
    ("EG", "Egipto", 26.82, 30.80), ("NG", "Nigeria", 9.08, 8.68), ("CA", "Canadá", 56.13, -106.35), ("INT", "Internacional", None, None), ("XX", "Sin ubicar", None, None),
)
# Id, name, country, latitude, longitude, words of a place; the more specific ones come first.
PLACES = (
    ("US-TX-PRESIDIO", "Presidio, Texas", "US", 29.561, -104.373, ("presidio county", "presidio, texas", "presidio")),
    ("US-TX-JEFFDAVIS", "Jeff Davis, Texas", "US", 30.746, -104.140, ("jeff davis county", "jeff davis", "jeffdavis")),
    ("MX-BC", "Baja California", "MX", 30.84, -115.28, ("baja california sur", "baja california")),
    ("US-NM", "Nuevo México", "US", 34.41, -106.11, ("new mexico", "nuevo méxico", "nuevo mexico")),
    ("US-TX", "Texas", "US", 31.0, -99.9, ("texas",)), ("US-AZ", "Arizona", "US", 34.27, -111.66, ("arizona",)), ("US-CA", "California", "US", 36.78, -119.42, ("california",)),
    ("US-FL", "Florida", "US", 27.66, -81.52, ("florida",)), ("US-IA", "Iowa", "US", 42.0, -93.5, ("iowa",)), ("US-NC", "Carolina del Norte", "US", 35.76, -79.02, ("north carolina", "carolina del norte")),
    ("MX-CHIS", "Chiapas", "MX", 16.75, -93.13, ("chiapas",)), ("MX-OAX", "Oaxaca", "MX", 17.07, -96.72, ("oaxaca",)), ("MX-TAB", "Tabasco", "MX", 17.84, -92.62, ("tabasco",)), ("MX-VER", "Veracruz", "MX", 19.17, -96.13, ("veracruz",)),
    ("MX-YUC", "Yucatán", "MX", 20.71, -89.09, ("yucatán", "yucatan")), ("MX-CAM", "Campeche", "MX", 19.83, -90.53, ("campeche",)), ("MX-ROO", "Quintana Roo", "MX", 19.18, -88.05, ("quintana roo",)),
    ("MX-TAMPS", "Tamaulipas", "MX", 24.27, -98.84, ("tamaulipas",)), ("MX-NL", "Nuevo León", "MX", 25.59, -99.99, ("nuevo león", "nuevo leon")), ("MX-COAH", "Coahuila", "MX", 27.06, -101.71, ("coahuila",)), ("MX-CHIH", "Chihuahua", "MX", 28.63, -106.07, ("chihuahua",)),
    ("MX-GTO", "Guanajuato", "MX", 21.02, -101.26, ("guanajuato",)), ("MX-JAL", "Jalisco", "MX", 20.66, -103.35, ("jalisco",)), ("MX-SON", "Sonora", "MX", 29.30, -110.93, ("sonora",)), ("MX-SIN", "Sinaloa", "MX", 25.17, -107.48, ("sinaloa",)),
    ("MX-GRO", "Guerrero", "MX", 17.44, -99.55, ("guerrero",)), ("MX-PUE", "Puebla", "MX", 19.04, -98.21, ("puebla",)),
)
# Words that mean a country, of equal length in this order.
ALIASES = (
    ("estados unidos", "US"), ("united states", "US"), ("ee. uu", "US"), ("eeuu", "US"), ("u.s.a", "US"), ("usa", "US"), ("méxico", "MX"), ("mexico", "MX"), ("guatemala", "GT"), ("honduras", "HN"), ("el salvador", "SV"), ("nicaragua", "NI"),
    ("costa rica", "CR"), ("panamá", "PA"), ("panama", "PA"), ("colombia", "CO"), ("venezuela", "VE"), ("brasil", "BR"), ("brazil", "BR"), ("argentina", "AR"), ("chile", "CL"), ("perú", "PE"), ("peru", "PE"), ("ecuador", "EC"), ("bolivia", "BO"),
    ("uruguay", "UY"), ("paraguay", "PY"), ("cuba", "CU"), ("república dominicana", "DO"), ("australia", "AU"), ("china", "CN"), ("japón", "JP"), ("japan", "JP"), ("india", "IN"), ("españa", "ES"), ("spain", "ES"), ("francia", "FR"), ("france", "FR"),
    ("alemania", "DE"), ("germany", "DE"), ("reino unido", "GB"), ("united kingdom", "GB"), ("suiza", "CH"), ("woah", "CH"), ("ginebra", "CH"), ("canadá", "CA"), ("canada", "CA"), ("sudáfrica", "ZA"), ("south africa", "ZA"), ("nigeria", "NG"),
    ("egipto", "EG"), ("belice", "BZ"), ("belize", "BZ"),
)
# Longer names that hide the one inside them.
HIDES = {"mexico": ("new mexico", "nuevo mexico", "nuevo méxico"), "méxico": ("nuevo méxico", "new mexico", "nuevo mexico"), "california": ("baja california sur", "baja california")}
LETTERS = "a-záéíóúüñ"
NOWHERE = ("XX", "INT", "")


def edge(needle: str) -> str | None:
    """Letters that may not stand beside a needle; none where it has a space or a dot."""
    return None if " " in needle or "." in needle else LETTERS


def terms() -> list[tuple[str, str, str, str | None]]:
    """What spans() looks for: each needle under its own name, and the longer names that hide others."""
    needles = dict.fromkeys([*(w for p in PLACES for w in p[5]), *(a for a, _ in ALIASES)])
    masks = dict.fromkeys(m for ms in HIDES.values() for m in ms)
    return [(n, n, "needle", edge(n)) for n in needles] + [(m, m, "mask", None) for m in masks]


def heard(found: Column) -> Column:
    """Distinct needles that a text names: those with a place that no longer name which hides them covers."""
    hides = F.create_map(*[c for n, ms in HIDES.items() for c in (F.lit(n), F.array(*[F.lit(m) for m in ms]))])
    needles, masks = (F.filter(found, lambda s: s["kind"] == kind) for kind in ("needle", "mask"))
    # the one-element array binds the masks once for all needles
    return F.transform(F.array(masks), lambda ms: F.array_distinct(F.transform(F.filter(needles, lambda s: ~F.exists(ms, lambda m: F.coalesce(F.array_contains(F.element_at(hides, s["canonical"]), m["canonical"]), F.lit(False)) & (m["at"] <= s["at"]) & (m["till"] >= s["till"]))), lambda s: s["canonical"])))[0]


def countries(needles: Column) -> Column:
    """Codes of the countries that needles mean, each once, those of longer needles first."""
    ranked = sorted(ALIASES, key=lambda a: -len(a[0]))
    order = F.array(*[F.lit(a) for a, _ in ranked])
    code = F.create_map(*[F.lit(x) for a in ranked for x in a])
    return F.array_distinct(F.transform(F.filter(order, lambda a: F.array_contains(needles, a)), lambda a: F.element_at(code, a)))


def place_of(needles: Column) -> Column:
    """Number of the first place that a needle means; null without one."""
    first = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(i).alias("i")) for i, p in enumerate(PLACES) for w in p[5]])
    return F.array_min(F.transform(F.filter(first, lambda f: F.array_contains(needles, f["w"])), lambda f: f["i"]))


_POINT = "struct<place_id: string, name: string, country: string, lat: double, lng: double, grain: string, unlocated: boolean>"


def resolved(stored: Column, needles: Column) -> Column:
    """Where an article belongs on the map: the stored place, else the first place its text names, else the stored country, else the first country it names, else nowhere."""
    raw = F.upper(F.trim(F.coalesce(stored, F.lit(""))))
    none = F.lit(None).cast("double")

    def row(i, name, country, lat, lng, grain):
        return F.struct(F.lit(i).alias("place_id"), F.lit(name).alias("name"), F.lit(country).alias("country"), (none if lat is None else F.lit(lat)).alias("lat"), (none if lng is None else F.lit(lng)).alias("lng"), F.lit(grain).alias("grain"), F.lit(lat is None).alias("unlocated")).cast(_POINT)

    places = F.array(*[row(*p[:5], "place") for p in PLACES])
    by_code = F.create_map(*[c for code, name, lat, lng in COUNTRIES for c in (F.lit(code), row(code, name, code, lat, lng, "country"))])
    own = F.array_position(F.array(*[F.lit(p[0]) for p in PLACES]), raw)
    known = F.array_contains(F.array(*[F.lit(c[0]) for c in COUNTRIES]), raw) & ~raw.isin(*NOWHERE)
    named = F.get(countries(needles), F.lit(0))
    code = F.when(known, raw).otherwise(F.coalesce(named, F.lit("XX")))
    return F.when(own > 0, F.get(places, (own - 1).cast("int"))).when(place_of(needles).isNotNull(), F.get(places, place_of(needles))).otherwise(F.coalesce(F.element_at(by_code, code), F.element_at(by_code, F.lit("XX"))))
