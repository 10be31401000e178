"""Cleaning of attribute names and values, as expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The closed vocabularies of the domain.
MACROAREAS = ("lote", "sistema_viario", "avl", "app", "aci", "nulo")
LAND_USES = ("residencial", "comercial", "servicos", "institucional", "industrial", "misto")
ROAD_STATUS = {
    "existente": "existente",
    "existing": "existente",
    "atual": "existente",
    "implantada": "existente",
    "viaexistente": "existente",
    "proposta": "proposta",
    "proposto": "proposta",
    "proposed": "proposta",
    "nova": "proposta",
    "novo": "proposta",
    "projetada": "proposta",
    "projetado": "proposta",
    "viaprojetada": "proposta",
    "viaproposta": "proposta",
}
MIXED = "misto"


@cache
def accents() -> tuple[str, str]:
    """Lower-case Latin letters whose decomposition is one letter and marks, and these letters."""
    pairs = [(chr(c), [x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(a, b[0]) for a, b in pairs if len(b) == 1 and b[0] != a and a == a.lower()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def normalize_key(text: Column) -> Column:
    """Lower case without accents, blanks and punctuation: the form in which keys are compared."""
    return F.regexp_replace(F.translate(F.lower(F.trim(text)), *accents()), r"[^\p{L}\p{N}]", "")


def repair_mojibake(text: Column) -> Column:
    """Undoes UTF-8 that was read as Latin-1; leaves all other text alone."""
    latin = text.rlike(r"^[\x{00}-\x{FF}]*$")
    raw = F.encode(text, "ISO-8859-1")
    return F.when(latin, F.when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8")).otherwise(text)).otherwise(text)


def repair_map(bag: Column) -> Column:
    """`repair_mojibake` on the names and the values of a map; of names that become equal the last stays."""
    return F.map_from_entries(_last_of_each(F.transform(F.map_entries(bag), lambda e: F.struct(repair_mojibake(e["key"]).alias("key"), repair_mojibake(e["value"]).alias("value")))))


def _last_of_each(entries: Column) -> Column:
    return F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))


def merge_maps(under: Column, over: Column) -> Column:
    """The union of two maps; `over` wins."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    under, over = F.coalesce(under, none), F.coalesce(over, none)
    return F.map_concat(F.map_filter(under, lambda k, _: ~F.map_contains_key(over, k)), over)


def resolve(text: Column, vocabulary: dict[str, str]) -> Column:
    """The vocabulary's value of a raw text by its normalized key; null if unknown."""
    # looked up: a key compared with each word would be worked out for each
    words = F.create_map(*(F.lit(v) for item in vocabulary.items() for v in item))
    return F.try_element_at(words, normalize_key(text))


def keyed(values: tuple[str, ...]) -> dict[str, str]:
    return {v.replace("_", ""): v for v in values}


def macroarea(text: Column) -> Column:
    return resolve(text, keyed(MACROAREAS))


def road_status(text: Column) -> Column:
    return resolve(text, ROAD_STATUS)


def land_use(text: Column) -> Column:
    """The class of a `;`-separated list: none known null, one itself, several mixed."""
    known = F.array_distinct(F.filter(F.transform(F.split(text, ";"), lambda t: resolve(t, keyed(LAND_USES))), lambda v: v.isNotNull()))
    return F.when(F.size(known) == 1, F.get(known, F.lit(0))).when(F.size(known) > 1, F.lit(MIXED))


def to_bool(text: Column) -> Column:
    key = normalize_key(text)
    return F.when(key.isin("1", "true", "sim", "yes"), F.lit(True)).when(key.isin("0", "false", "nao", "no"), F.lit(False)).when(F.trim(text).try_cast("double").isNotNull(), F.trim(text).try_cast("double") != 0)


def to_decimal(text: Column) -> Column:
    return F.trim(text).try_cast("decimal(38,10)")


def to_non_negative(text: Column) -> Column:
    return F.when(to_decimal(text) >= 0, to_decimal(text))


def to_area(text: Column) -> Column:
    """A number, with or without the suffix m²; null for other text."""
    return to_decimal(F.regexp_replace(F.trim(text), r"\s*m²$", ""))


def area_unreadable(text: Column) -> Column:
    """Whether an area is given but can't be read: worth a warning."""
    return text.isNotNull() & (F.trim(text) != "") & to_area(text).isNull()


def to_group_key(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))
