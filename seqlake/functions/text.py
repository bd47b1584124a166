"""Functions of names and option strings."""

from __future__ import annotations

import csv

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, read with regard to case, of names that mark an unclassified or artificial origin.
UNCLASSIFIED = (
    r"-like", r"Taxon\d\d", r"acidophile", r"actinobacterium", r"aerobic", r"\b[Al]g(um|a)\b", r"\b[Bb]acteri(um|a)", r"Barophile", r"cyanobacterium", r"Chloroplast",
    r"[Cc]lone", r"[Cc]loning", r"cluster", r"-containing", r"environmental", r"epibiont", r"eubacterium", r"\b[Gg]roup\b", r"halophilic", r"hydrothermal\b", r"isolate",
    r"marine", r"methanotroph", r"microorganism", r"mollicute", r"pathogen", r"[Pp]hytoplasma", r"proteobacterium", r"putative", r"\bsp\.", r"species", r"spirochete", r"str\.",
    r"strain", r"symbiont", r"taxon", r"unicellular", r"uncultured", r"unclassified", r"unidentified", r"unknown", r"vector\b", r"vent\b",
)
#: What older software looked for in place of some of these patterns: two of them run together, and a control character.
OLD_PATTERNS = {r"str\.": r"str\.strain", r"strain": None, r"vector\b": "vector\x08"}


def is_unclassified(name: Column, old: bool = False) -> Column:
    """Whether a name holds one of the patterns; old: with OLD_PATTERNS, for results like those of older software."""
    found = [OLD_PATTERNS.get(x, x) if old else x for x in UNCLASSIFIED]
    return F.coalesce(name.rlike("|".join(x for x in found if x)), F.lit(False))


def is_type_strain(description: Column) -> Column:
    return F.coalesce(description.contains("(T)"), F.lit(False))


def safe_name(name: Column) -> Column:
    """`:` becomes `_`."""
    return F.translate(name, ":", "_")


def newick_name(name: Column, prefix: str = "", suffix: str = "", remove: str | None = None) -> Column:
    """A leaf name that Newick can hold: `:` becomes `|`, blanks become `_`."""
    out = F.translate(F.trim(name), ": ", "|_")
    if remove:
        out = F.regexp_replace(out, remove, "")
    return F.trim(F.concat(F.lit(prefix), out, F.lit(suffix)))


def typed(value: str) -> int | float | str:
    """An option's value: a whole number, a number, or a stripped string."""
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return value.strip()


def parse_pairs(text: str) -> dict[str, int | float | str]:
    """`k:v,k:v` with quotes around what holds commas."""
    fields = next(csv.reader([text]), [])
    return {k.strip(): typed(v) for k, _, v in (f.partition(":") for f in fields) if k.strip()}


def parse_split(text: str) -> tuple[str, str, list[str]]:
    """`column:delimiter:name,name` -> column, delimiter, new names."""
    column, delimiter, names = text.split(":", 2)
    return column, delimiter, [n.strip() for n in names.split(",")]


def taxid_of_features(features: Column) -> Column:
    """Digits after `taxon:` in a source feature's db_xref; features: array of struct(type, qualifiers map<string, array<string>>)."""
    sources = F.filter(features, lambda f: f["type"] == "source")
    refs = F.flatten(F.transform(sources, lambda f: F.coalesce(f["qualifiers"]["db_xref"], F.array().cast("array<string>"))))
    hit = F.filter(refs, lambda r: r.startswith("taxon:"))
    return F.when(F.size(hit) > 0, F.regexp_extract(F.get(hit, F.lit(0)), r"(\d+)", 1))
