"""Code and name normalisers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Salt and hydrate words that end an ingredient name.
SALTS = [
    "hydrochloride", "hcl", "sodium", "potassium", "magnesium", "calcium", "zinc", "aluminum", "aluminium", "sulfate",
    "sulphate", "acetate", "tartrate", "maleate", "fumarate", "succinate", "citrate", "gluconate", "mesylate", "mesilate",
    "tosylate", "besylate", "bromide", "phosphate", "carbonate", "bicarbonate", "lactate", "monohydrate", "dihydrate", "trihydrate",
    "hemihydrate", "sesquihydrate", "tetrahydrate", "pentahydrate", "hexahydrate", "anhydrous", "anhydrate", "hydrate", "monosodium", "disodium",
    "hemisulfate", "hemifumarate", "strontium", "ammonium", "chloride", "monohydrochloride", "dihydrochloride", "tromethamine", "trifenatate", "propionate",
    "valerate", "dipropionate", "pivalate", "dimethylsulfoxide", "decanoate", "enanthate", "undecylenate",
]
_SALT = r"(?i)\s+(?:" + "|".join(SALTS) + r")$"
# What ends a name as a dose, and what names the base of a salt.
_DOSE = r"(?i)\s+\d[\d.,]*\s*(?:mg|g|ml|mcg|%|iu|unit|u|mmol|meq|ug|μg|μ)[^,]*$"
_AS = r"(?i)\(as\s+([a-z][a-z\s\-]+?)(?:\s+[\d(].*?)?\)"

# Severity by the first class with a phrase in the description.
SEVERITY_PHRASES = {
    "Contraindicated": [r"\bcontraindicated\b", r"must not be (used|taken|combined)", r"should not be (used|taken|combined) (together|concomitantly)"],
    "Major": [
        r"\blife[ -]threatening\b", r"\bfatal\b", r"\bdeath\b",
        r"risk or severity of (bleeding|hemorrhage|cardiac|toxicity|seizure|arrhythmia|rhabdomyolysis|neutropenia|thrombocytopenia|bone marrow)",
        r"\bsevere (toxicity|adverse|bleeding|hemorrhage)\b", r"\bserious (adverse|toxicity|bleeding)\b",
        r"risk of (torsades|ventricular fibrillation|cardiac arrest)", r"serotonin syndrome", r"bone marrow (suppression|toxicity)", r"acute (kidney|renal) (failure|injury)",
    ],
    "Moderate": [
        r"risk or severity of", r"may (increase|decrease|enhance|reduce) the .*(activit|effect|level|concentration)", r"(can|could|may) be (increased|decreased|enhanced|reduced)",
        r"(adverse|side) effects can be (increased|reduced)", r"(increase|decrease)s? the (risk|likelihood) of",
    ],
}


def missing_to_null(c: Column) -> Column:
    """Blank text and the texts nan and None are missing."""
    t = F.trim(c.cast("string"))
    return F.when(~F.lower(t).isin("", "nan", "none"), t)


def edi_code(c: Column) -> Column:
    """Nine digits: blanks and a trailing .0 go, shorter ones get zeros on the left, longer ones stay."""
    t = F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")
    return F.when(t.rlike(r"^[0-9]+$"), F.when(F.length(t) >= 9, t).otherwise(F.lpad(t, 9, "0")))


def _without_salts(c: Column) -> Column:
    for _ in range(3):
        c = F.regexp_replace(F.trim(c), _SALT, "")
    return F.lower(F.trim(c))


def ingredient(c: Column) -> Column:
    """Base name of an ingredient: the base in "(as BASE ..)" wins, else dose, brackets and salts go."""
    base = F.regexp_extract(c, _AS, 1)
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), _DOSE, ""), r"\s*\([^)]*\)?", "")
    return F.when(F.trim(base) != "", _without_salts(base)).otherwise(_without_salts(bare))


def components(c: Column) -> Column:
    """Normalised components of a combination: cut at commas before a letter; names of 2 or fewer go."""
    return F.filter(F.transform(F.split(c, r",\s*(?=[a-zA-Z가-힣(])"), ingredient), lambda x: F.length(x) > 2)


def is_combination(code: Column) -> Column:
    return F.substring(code, 5, 2) == "00"


def atc_level(code: Column, level: int) -> Column:
    """Prefix of ATC level 3, 4 or 5 (4, 5, 7 characters); a shorter code is itself."""
    return F.substring(code, 1, {3: 4, 4: 5, 5: 7}[level])


def icd_code(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), r"[.\s]|\*+$", "")


def code_list(c: Column) -> Column:
    """Codes of a cell with several, cut at commas and semicolons, blanks gone."""
    return F.filter(F.transform(F.split(c, "[,;]"), lambda x: icd_code(F.trim(x))), lambda x: x != "")


def codes_in_text(c: Column, pattern: str = r"\b[A-Z][0-9]{2}(?:\.[0-9])?\b") -> Column:
    """Distinct codes in free text, in the order they are first seen."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))


def severity_of(c: Column) -> Column:
    """Severity from free text: the first class with a phrase in it, else Minor; blank is Unknown."""
    out = F.when(c.isNull() | (c == ""), "Unknown")
    for name, phrases in SEVERITY_PHRASES.items():
        out = out.when(c.rlike("(?i)" + "|".join(f"(?:{p})" for p in phrases)), name)
    return out.otherwise("Minor")


def age_at(ref_year: int, byear: Column, fallback: Column) -> Column:
    return F.when(byear.isNotNull(), F.least(F.lit(120), F.greatest(F.lit(0), F.lit(ref_year) - byear))).otherwise(fallback)


def age_band(age: Column) -> Column:
    """[0, 20, 40, 60, 75, 200) as text, unknown outside."""
    edges = (0, 20, 40, 60, 75, 200)
    out = F.when(age.isNull() | (age < 0), "unknown")
    for low, high in zip(edges, edges[1:]):
        out = out.when(age < high, f"{low}-{high - 1}" if high < 200 else f"{low}+")
    return out.otherwise("unknown")


def review_group(age: Column) -> Column:
    return F.when(age < 65, "lt65").when(age < 75, "65-74").when(age >= 75, "75plus").otherwise("unknown")


def sex_value(c: Column) -> Column:
    return F.when(c == "1", 1.0).when(c == "2", 0.0).otherwise(0.5)


def decade_age(c: Column) -> Column:
    """Age from a decade id: its floor."""
    return c.try_cast("int") * 10


def risk_code(level: Column) -> Column:
    return F.when(level == "Normal", 0).when(level == "Green", 1).when(level == "Yellow", 2).when(level == "Red", 3)


def pseudonym(c: Column, salt: str) -> Column:
    """SHA-256 of salt:value; null stays null."""
    return F.sha2(F.concat(F.lit(f"{salt}:"), c.cast("string")), 256)


def percent(part: Column, whole: Column) -> Column:
    """Per cent to 4 places, 0 of nothing."""
    return F.when(whole == 0, 0.0).otherwise(F.round(part / whole * 100, 4))


def strict_days(c: Column) -> Column:
    """Days of supply: blank and 0 count as 1, a trailing .0 goes, any other text raises."""
    t = F.regexp_replace(F.trim(F.coalesce(c.cast("string"), F.lit(""))), r"\.0+$", "")
    return F.when(t.isin("", "0"), 1).when(t.rlike(r"^[0-9]+$"), t.try_cast("int")).otherwise(F.raise_error(F.concat(F.lit("not a number of days: "), t)).cast("int"))


def repaired_components(parts: Column, parsed: Column, known: Column) -> Column:
    """Components parsed anew are taken only if they map to a strict superset of the known ids."""
    old, new = F.array_intersect(parts, known), F.array_intersect(parsed, known)
    return F.when((F.size(F.array_except(old, new)) == 0) & (F.size(new) > F.size(old)), parsed).otherwise(parts)
