"""Risk rules: triggers, levels, subtypes, rule tables over drug groups, fusion with a model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .features import in_group

LEVELS = ("Normal", "Green", "Yellow", "Red")


def _names(**conditions: Column) -> Column:
    """Sorted array of the names whose condition holds."""
    return F.array_sort(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in conditions.items()))))


def red_triggers() -> Column:
    return _names(RED_CONTRAINDICATED=F.col("ddi_contraindicated") >= 1)


def severe_triggers() -> Column:
    organ = F.col("renal_risk") | F.col("hepatic_risk")
    return _names(
        SEV_TRIPLE_WHAMMY=F.col("triple_whammy"),
        SEV_10DRUG_HIGHRISK=(F.col("drug_count") >= 10) & F.col("high_risk"),
        SEV_ELDERLY_ORGAN=(F.coalesce("age", F.lit(-1)) >= 75) & (F.col("drug_count") >= 5) & organ,
    )


def yellow_triggers() -> Column:
    return _names(DDI_MAJOR=F.col("ddi_major") >= 1, DDI_MOD=F.col("ddi_moderate") >= 2, DUP=F.col("dup_same_ingredient") >= 1, FRAG=F.col("institution_count") >= 3)


def grade(features: DataFrame) -> DataFrame:
    """risk_level, risk_reasons and yellow_subtype of each feature row."""
    t = features.withColumns({"_red": red_triggers(), "_severe": severe_triggers(), "_yellow": yellow_triggers()})
    yellow = F.array_sort(F.array_union("_severe", "_yellow"))
    level = (
        F.when(F.size("_red") > 0, "Red").when(F.size(yellow) > 0, "Yellow").when((F.col("ddi_minor") >= 1) | (F.col("drug_count") >= 5), "Green").otherwise("Normal")
    )
    green = F.when(F.col("ddi_minor") >= 1, F.array(F.concat(F.lit("MINOR_DDI:"), F.col("ddi_minor").cast("string")))).otherwise(F.array(F.concat(F.lit("DRUGS:"), F.col("drug_count").cast("string"))))
    reasons = F.when(level == "Red", F.col("_red")).when(level == "Yellow", yellow).when(level == "Green", green).otherwise(F.array().cast("array<string>"))
    mod, dup, frag = (F.array_contains("_yellow", n) for n in ("DDI_MOD", "DUP", "FRAG"))
    dims = mod.cast("int") + dup.cast("int") + frag.cast("int")
    subtype = F.when(level == "Yellow", F.when(F.col("ddi_major") >= 1, "Y_DDI_MAJOR").when((F.size("_severe") > 0) | (dims >= 3), "Y_TRIPLE").when(dims == 2, "Y_DOUBLE").when(mod, "Y_DDI_MOD").when(dup, "Y_DUP").when(frag, "Y_FRAG").otherwise("Y_OTHER"))
    return t.select(*features.columns, level.alias("risk_level"), reasons.alias("risk_reasons"), subtype.alias("yellow_subtype"))


# How a trigger reads on the intervention list, with the count that it gives and its unit.
REASONS = {
    "RED_CONTRAINDICATED": ("금기 DDI", "ddi_contraindicated", "건"),
    "SEV_TRIPLE_WHAMMY": ("Triple Whammy", None, None),
    "SEV_10DRUG_HIGHRISK": ("10종↑+고위험약", None, None),
    "SEV_ELDERLY_ORGAN": ("고령(75+)+장기부전", None, None),
    "DDI_MAJOR": ("중증 DDI", "ddi_major", "건"),
    "DDI_MOD": ("Moderate DDI", "ddi_moderate", "쌍"),
    "DUP": ("동일성분 중복", "dup_same_ingredient", "건"),
    "FRAG": ("다기관(3곳↑)", None, None),
}
#: Labels on the list, the most urgent first, and what is done.
INTERVENTIONS = {"Red": "즉각 개입", "Y_DDI_MAJOR": "약사 전화", "Y_TRIPLE": "문자 안내"}


def reason_text() -> Column:
    """Why a feature row has its grade, by the triggers themselves: the red ones, or else the severe and the yellow ones."""
    red = red_triggers()
    triggers = F.when(F.size(red) > 0, red).otherwise(F.array_sort(F.array_union(severe_triggers(), yellow_triggers())))
    text = {t: F.concat(F.lit(f"{ko} "), F.col(count).cast("string"), F.lit(unit)) if count else F.lit(ko) for t, (ko, count, unit) in REASONS.items()}
    texts = F.create_map(*(x for t, c in text.items() for x in (F.lit(t), c)))
    green = F.when(F.col("ddi_minor") >= 1, F.concat(F.lit("Minor DDI "), F.col("ddi_minor").cast("string"), F.lit("건"))).when(F.col("drug_count") >= 5, F.concat(F.lit("5종↑ ("), F.col("drug_count").cast("string"), F.lit("종)"))).otherwise("")
    return F.when(F.size(triggers) > 0, F.array_join(F.transform(triggers, lambda t: texts[t]), ", ")).otherwise(green)


def intervention_list(graded: DataFrame, keys: list[str]) -> DataFrame:
    """Graded rows that call for an intervention: what is done, label, reasons and counts, by priority, then keys."""
    label = F.when(F.col("risk_level") == "Red", "Red").otherwise(F.col("yellow_subtype"))
    listed = graded.withColumn("label", label).where(F.col("label").isin(*INTERVENTIONS))
    done = F.create_map(*(F.lit(x) for kv in INTERVENTIONS.items() for x in kv))[F.col("label")]
    priority = F.array_position(F.array(*map(F.lit, INTERVENTIONS)), F.col("label")).cast("int") - 1
    counts = ["drug_count", "ddi_major", "ddi_contraindicated", "dup_same_ingredient", "institution_count"]
    return listed.select(*keys, "risk_level", priority.alias("priority"), done.alias("intervention"), "label", reason_text().alias("reasons"), *counts).orderBy("priority", *keys)


def level_code(level: Column) -> Column:
    return F.when(level == "Green", 1).when(level == "Yellow", 2).when(level == "Red", 3).otherwise(0)


def level_name(code: Column) -> Column:
    return F.when(code == 3, "Red").when(code == 2, "Yellow").when(code == 1, "Green").otherwise("Normal")


def safety_net_grade(c: DataFrame) -> DataFrame:
    """The other grade: three majors, a triple whammy or three QT drugs are Red here."""
    organ = F.col("renal_risk") | F.col("hepatic_risk")
    red = (F.col("ddi_contraindicated") >= 1) | (F.col("ddi_major") >= 3) | F.col("triple_whammy") | (F.col("qt_drugs") >= 3) | ((F.col("drug_count") >= 10) & F.col("high_risk")) | ((F.coalesce("age", F.lit(-1)) >= 75) & (F.col("drug_count") >= 5) & organ)
    out = F.when(red, "Red").when((F.col("ddi_major") >= 1) | (F.col("ddi_moderate") >= 2), "Yellow").when((F.col("ddi_minor") > 0) | (F.col("drug_count") >= 5), "Green").otherwise("Normal")
    return c.withColumn("safety_grade", out)


# Drug groups as (name keywords, ATC prefixes).
GROUPS = {
    "warfarin": (["warfarin", "coumadin", "jantoven"], ["B01AA03"]),
    "doac": (["rivaroxaban", "apixaban", "dabigatran", "edoxaban", "betrixaban"], ["B01AF01", "B01AF02", "B01AE07", "B01AF03", "B01AF04"]),
    "anticoagulants_all": (
        ["warfarin", "coumadin", "rivaroxaban", "apixaban", "dabigatran", "edoxaban", "betrixaban", "acenocoumarol", "phenprocoumon", "heparin", "enoxaparin", "fondaparinux"],
        ["B01AA", "B01AB", "B01AE", "B01AF"],
    ),
    "nsaids": (
        ["ibuprofen", "naproxen", "diclofenac", "celecoxib", "ketoprofen", "indomethacin", "meloxicam", "piroxicam", "ketorolac", "aspirin", "acetylsalicylic"],
        ["M01AA", "M01AB", "M01AC", "M01AE", "M01AG", "M01AH", "N02BA01"],
    ),
    "clopidogrel": (["clopidogrel", "plavix"], ["B01AC04"]),
    "antiplatelet_p2y12": (["clopidogrel", "prasugrel", "ticagrelor", "ticlopidine"], ["B01AC04", "B01AC22", "B01AC24", "B01AC05"]),
    "ppi_cyp2c19": (["omeprazole", "esomeprazole", "lansoprazole", "pantoprazole", "rabeprazole"], ["A02BC01", "A02BC05", "A02BC03", "A02BC02", "A02BC04"]),
    "acei": (["enalapril", "lisinopril", "ramipril", "captopril", "perindopril", "quinapril", "fosinopril", "benazepril", "trandolapril", "moexipril"], ["C09AA"]),
    "arb": (["losartan", "valsartan", "irbesartan", "candesartan", "olmesartan", "telmisartan", "azilsartan", "fimasartan"], ["C09CA"]),
    "k_sparing_diuretics": (
        ["spironolactone", "eplerenone", "amiloride", "triamterene", "finerenone", "canrenone", "canrenoate"],
        ["C03DA01", "C03DA02", "C03DA03", "C03DA04", "C03DA05", "C03DB01", "C03DB02"],
    ),
    "digoxin": (["digoxin", "digitoxin", "lanoxin"], ["C01AA05", "C01AA04"]),
    "amiodarone": (["amiodarone", "cordarone"], ["C01BD01"]),
    "verapamil": (["verapamil", "calan", "isoptin"], ["C08DA01"]),
    "methotrexate": (["methotrexate", "mtx"], ["L01BA01", "L04AX03"]),
    "trimethoprim_smx": (["trimethoprim", "sulfamethoxazole", "co-trimoxazole", "bactrim", "septra", "cotrimoxazole"], ["J01EA01", "J01EC01", "J01EE01"]),
    "ssri": (
        ["fluoxetine", "sertraline", "paroxetine", "fluvoxamine", "citalopram", "escitalopram", "vilazodone", "vortioxetine"],
        ["N06AB04", "N06AB06", "N06AB05", "N06AB08", "N06AB10", "N06AB09"],
    ),
    "maoi": (
        ["phenelzine", "tranylcypromine", "isocarboxazid", "selegiline", "rasagiline", "safinamide", "moclobemide", "linezolid", "methylene blue"],
        ["N06AF01", "N06AF02", "N06AF03", "N06AG02", "N02AX", "J01XX08"],
    ),
    "triptan": (
        ["sumatriptan", "rizatriptan", "zolmitriptan", "naratriptan", "frovatriptan", "almotriptan", "eletriptan"],
        ["N02CC01", "N02CC02", "N02CC03", "N02CC04", "N02CC05", "N02CC06", "N02CC07"],
    ),
    "lithium": (["lithium", "lithobid", "eskalith"], ["N05AN01"]),
    "loop_thiazide_diuretics": (
        ["furosemide", "torsemide", "bumetanide", "hydrochlorothiazide", "chlorthalidone", "indapamide", "metolazone"],
        ["C03CA01", "C03CA04", "C03CB01", "C03AA03", "C03BA11", "C03BA51", "C03BA08"],
    ),
    "qt_prolonging": (
        [
            "amiodarone", "sotalol", "quinidine", "disopyramide", "haloperidol", "chlorpromazine", "thioridazine", "quetiapine", "ziprasidone", "ondansetron", "azithromycin", "clarithromycin",
            "erythromycin", "ciprofloxacin", "moxifloxacin", "levofloxacin", "methadone", "domperidone", "hydroxychloroquine", "chloroquine",
        ],
        ["C01BD", "C01BA", "N05A", "N05AH", "A04AA", "J01FA", "J01MA", "N07BC02"],
    ),
    "statin": (
        ["atorvastatin", "simvastatin", "rosuvastatin", "pravastatin", "lovastatin", "fluvastatin", "pitavastatin", "cerivastatin"],
        ["C10AA01", "C10AA02", "C10AA07", "C10AA03", "C10AA02", "C10AA04"],
    ),
    "macrolide_strong": (["clarithromycin", "erythromycin", "telithromycin"], ["J01FA09", "J01FA01", "J01FA15"]),
}

# Rules as (id, name, groups of which one each must be present, least drugs of the first, severity).
RULES = [
    ("TOP01", "Anticoagulant_NSAIDs", [["anticoagulants_all"], ["nsaids"]], 1, "Major"),
    ("TOP02", "Clopidogrel_PPI_CYP2C19", [["clopidogrel"], ["ppi_cyp2c19"]], 1, "Moderate"),
    ("TOP03", "Triple_Whammy", [["acei", "arb"], ["k_sparing_diuretics"], ["nsaids"]], 1, "Major"),
    ("TOP04", "Digoxin_Amiodarone_Verapamil", [["digoxin"], ["amiodarone", "verapamil"]], 1, "Major"),
    ("TOP05", "Methotrexate_Trimethoprim", [["methotrexate"], ["trimethoprim_smx"]], 1, "Contraindicated"),
    ("TOP06", "SSRI_MAOi_SerotoninSyndrome", [["ssri"], ["maoi"]], 1, "Contraindicated"),
    ("TOP07", "SSRI_Triptan_SerotoninSyndrome", [["ssri"], ["triptan"]], 1, "Major"),
    ("TOP08", "Lithium_NSAIDs_Diuretics", [["lithium"], ["nsaids", "loop_thiazide_diuretics"]], 1, "Major"),
    ("TOP09", "QT_Prolongation_Multiple", [["qt_prolonging"]], 3, "Major"),
    ("TOP10", "Statin_Macrolide_Rhabdomyolysis", [["statin"], ["macrolide_strong"]], 1, "Major"),
]

#: Further groups of the patterns of several drugs, as (name keywords, ATC prefixes).
PATTERN_GROUPS = GROUPS | {
    "antiplatelets": (["aspirin", "clopidogrel", "prasugrel", "ticagrelor"], ["B01AC"]),
    "antipsychotics": ([], ["N05A"]),
    "macrolides": ([], ["J01FA"]),
    "quinolones": ([], ["J01M"]),
    "insulins_sulfonylureas": (["insulin", "glimepiride", "gliclazide", "glipizide", "glyburide"], ["A10A", "A10BB"]),
    "beta_blockers": ([], ["C07"]),
    "simvastatin": (["simvastatin"], ["C10AA01"]),
    "clarithromycin": (["clarithromycin"], ["J01FA09"]),
    "opioids": ([], ["N02A"]),
    "benzodiazepines": ([], ["N05BA", "N05CD"]),
    "antihistamines": ([], ["R06A"]),
    "antibiotics": ([], ["J01"]),
}

# The twelve patterns of three (P2: two) groups each.
PATTERNS = [
    ("P1", "Triple Whammy", [["acei"], ["k_sparing_diuretics"], ["nsaids"]], 1, "Major"),
    ("P2", "Serotonin Syndrome A", [["ssri"], ["maoi"]], 1, "Major"),
    ("P3", "Serotonin Syndrome B", [["ssri"], ["triptan"], ["maoi"]], 1, "Major"),
    ("P4", "Bleeding Triad", [["warfarin"], ["antiplatelets"], ["nsaids"]], 1, "Major"),
    ("P5", "QT Triple", [["antipsychotics"], ["macrolides"], ["quinolones"]], 1, "Major"),
    ("P6", "Digoxin Toxicity", [["digoxin"], ["amiodarone"], ["verapamil"]], 1, "Major"),
    ("P7", "MTX Toxicity", [["methotrexate"], ["trimethoprim_smx"], ["nsaids"]], 1, "Major"),
    ("P8", "Lithium Toxicity", [["lithium"], ["nsaids"], ["loop_thiazide_diuretics"]], 1, "Major"),
    ("P9", "Hypoglycemia Mask", [["insulins_sulfonylureas"], ["beta_blockers"], ["acei"]], 1, "Major"),
    ("P10", "Statin Toxicity", [["simvastatin"], ["amiodarone"], ["clarithromycin"]], 1, "Major"),
    ("P11", "CNS Depression", [["opioids"], ["benzodiazepines"], ["antihistamines"]], 1, "Major"),
    ("P12", "Anticoagulation Cascade", [["warfarin"], ["antibiotics"], ["nsaids"]], 1, "Major"),
]


Groups = dict[str, tuple[list[str], list[str]]]


def group_table(spark: SparkSession, groups: Groups) -> DataFrame:
    """Drug groups as rows (grp, keyword, prefix), one of the two null: a fixed small table."""
    rows = [(g, w, None) for g, (words, _) in groups.items() for w in words] + [(g, None, p) for g, (_, prefixes) in groups.items() for p in prefixes]
    return spark.createDataFrame(rows, "grp string, keyword string, prefix string")


def memberships(drugs: DataFrame, groups: DataFrame, code: str = "atc_code", name: str | None = None) -> DataFrame:
    """Each drug row with each group that it is in, by a keyword in its name or a prefix of its code."""
    hit = F.col(code).startswith(F.col("prefix"))
    if name:
        hit = F.coalesce(hit, F.lit(False)) | F.coalesce(F.lower(name).contains(F.col("keyword")), F.lit(False))
    return drugs.join(F.broadcast(groups), hit).drop("keyword", "prefix").distinct()


#: Clauses that one number holds a bit each of.
_CLAUSES = 60


def apply_rules(members: DataFrame, rules: list[tuple[str, str, list[list[str]], int, str]], keys: list[str], drug: str = "drug_id") -> DataFrame:
    """Rules that hold for each key, from (keys, drug, grp) rows: keys, rule, name, severity.

    A rule's clauses are met by one of their groups each. A group stands for the bits of its clauses, so a drug is one
    row and a key one row, whatever the number of rules; only clauses that ask for several drugs are counted. New
    rules are new rows of the list.
    """
    spark = members.sparkSession
    clauses = [(groups, least if k == 0 else 1) for _, _, found, least, _ in rules for k, groups in enumerate(found)]
    words = [f"_w{w}" for w in range(-(-len(clauses) // _CLAUSES))]
    bits: dict[str, list[int]] = {}
    for i, (groups, _) in enumerate(clauses):
        for g in groups:
            bits.setdefault(g, [0] * len(words))[i // _CLAUSES] |= 1 << i % _CLAUSES
    table = F.broadcast(spark.createDataFrame([(g, *found) for g, found in bits.items()], ", ".join(["grp string", *(f"{w} long" for w in words)])))

    def meets(i: int) -> Column:
        return F.col(words[i // _CLAUSES]).bitwiseAND(F.lit(1 << i % _CLAUSES)) != 0

    several = [i for i, (_, least) in enumerate(clauses) if least > 1]
    rows = members.where(F.col(drug).isNotNull()).select(*keys, drug, "grp").join(table, "grp")
    if several:
        rows = rows.groupBy(*keys, drug).agg(*(F.bit_or(w).alias(w) for w in words))
    found = rows.groupBy(*keys).agg(*(F.bit_or(w).alias(w) for w in words), *(F.count_if(meets(i)).alias(f"_n{i}") for i in several))
    held, at = [], 0
    for rule, name, parts, _, severity in rules:
        met = [F.col(f"_n{i}") >= clauses[i][1] if clauses[i][1] > 1 else meets(i) for i in range(at, at + len(parts))]
        held.append(F.when(reduce(Column.__and__, met), F.struct(F.lit(rule).alias("rule"), F.lit(name).alias("name"), F.lit(severity).alias("severity"))))
        at += len(parts)
    return found.select(*keys, F.inline(F.filter(F.array(*held), lambda x: x.isNotNull())))


#: What each safety grade asks for, in words.
GRADE_TEXT = {"Red": "high risk: act now", "Yellow": "medium risk: monitor monthly", "Green": "low risk: inform quarterly", "Normal": "normal"}


def assess(members: DataFrame, pairs: DataFrame, keys: list[str], rules: list = RULES, drug: str = "drug_id") -> DataFrame:
    """Rules and rated pairs of each key together, before grading.

    members: (keys, drug, grp) rows. pairs: (keys, drug_a, drug_b, severity) rows of the interaction matrix; a pair
    that is named twice counts once, with its higher severity. Result: keys, counts by severity (rules count too),
    triple_whammy, qt_drugs, triggered_rules.
    """
    from .knowledge import SEVERITIES, rank, severity

    hits = apply_rules(members, rules, keys, drug)
    best = pairs.groupBy(*keys, F.least("drug_a", "drug_b").alias("lo"), F.greatest("drug_a", "drug_b").alias("hi")).agg(F.max(rank(F.col("severity"))).alias("rank"))
    both = hits.select(*keys, F.concat_ws(": ", "rule", "name").alias("rule"), "severity").unionByName(best.where("rank > 0").select(*keys, F.lit(None).cast("string").alias("rule"), severity(F.col("rank")).alias("severity")))
    found = both.groupBy(*keys).agg(
        *(F.count_if(F.col("severity") == s).alias(f"ddi_{s.lower()}") for s in reversed(SEVERITIES)),
        F.array_sort(F.collect_set("rule")).alias("triggered_rules"),
        F.bool_or(F.coalesce(F.col("rule").startswith("TOP03"), F.lit(False))).alias("triple_whammy"),
    )
    qt = members.where("grp = 'qt_prolonging'").groupBy(*keys).agg(F.countDistinct(drug).alias("qt_drugs"))
    return found.join(qt, keys, "full").withColumns({
        **{f"ddi_{s.lower()}": F.coalesce(f"ddi_{s.lower()}", F.lit(0)) for s in SEVERITIES}, "qt_drugs": F.coalesce("qt_drugs", F.lit(0)),
        "triple_whammy": F.coalesce("triple_whammy", F.lit(False)), "triggered_rules": F.coalesce("triggered_rules", F.array().cast("array<string>")),
    })


def explanation(c: DataFrame) -> Column:
    """Grade and findings of an assessed row in words."""
    grade = F.create_map(*(F.lit(x) for kv in GRADE_TEXT.items() for x in kv))[F.col("safety_grade")]

    def counted(text: str, n: str) -> Column:
        return F.when(F.col(n) > 0, F.concat(F.lit(f"{text} "), F.col(n).cast("string")))

    qt = F.when(F.col("qt_drugs") >= 3, F.concat(F.lit("QT drugs "), F.col("qt_drugs").cast("string")))
    return F.concat_ws("; ", grade, counted("contraindicated", "ddi_contraindicated"), counted("major", "ddi_major"), F.when(F.col("triple_whammy"), "triple whammy"), qt, F.nullif(F.concat_ws(", ", "triggered_rules"), F.lit("")))


def subtype_level(label: Column) -> Column:
    """Level of a second-stage label: subtypes are Yellow, levels are themselves, any other text is Normal."""
    return F.when(label.startswith("Y_"), "Yellow").when(label.isin(*LEVELS), label).otherwise("Normal")


def stage2_label(level: Column, subtype: Column) -> Column:
    """Class of the second stage: a Yellow row's subtype, else its level; combinations that can't be raise."""
    wrong = (level == "Red") | ((level == "Yellow") & subtype.isNull()) | ((level != "Yellow") & subtype.isNotNull()) | level.isNull()
    bad = F.raise_error(F.concat(F.lit("no second-stage class: "), F.coalesce(level, F.lit("null")), F.lit(" / "), F.coalesce(subtype, F.lit("null")))).cast("string")
    return F.when(wrong, bad).when(level == "Yellow", subtype).otherwise(level)


# Classes in which duplicate therapy is accepted.
EXCEPTIONS = [
    ("E1", ["C02", "C03", "C07", "C08", "C09"]), ("E2", ["A10"]), ("E3", ["R03"]), ("E4", ["N02", "M01"]), ("E5", ["B01AC"]), ("E6", ["C01", "C03", "C07", "C09"]),
    ("E7", ["N05", "N06"]), ("E8", ["M01", "M04"]), ("E9", ["L01", "L02", "L03", "L04"]),
]


def exception_code(atc: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, prefixes in EXCEPTIONS:
        out = out.when(in_group(F.lit(""), atc, ([], prefixes)), name)
    return out


def duplicate_levels(drugs: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of a key's ATC codes that share level 5 (1), level 4 (2) or level 3 (3), with their exception.

    Codes are made distinct first and met by their level-3 prefix, so a pair is made only in its class.
    """
    codes = drugs.where("length(atc_code) >= 4").groupBy(*keys, "atc_code").agg(F.count(F.lit(1)).alias("n")).withColumn("p3", F.substring("atc_code", 1, 4))
    a, b = codes.select(*keys, "p3", F.col("atc_code").alias("atc_a"), "n"), codes.select(*keys, "p3", F.col("atc_code").alias("atc_b"))
    pairs = a.drop("n").join(b, [*keys, "p3"]).where("atc_a < atc_b").drop("p3")
    pairs = pairs.unionByName(a.where("n >= 2").select(*keys, "atc_a", F.col("atc_a").alias("atc_b")))

    def same(n: int) -> Column:
        return (F.substring("atc_a", 1, n) == F.substring("atc_b", 1, n)) & (F.length("atc_a") >= n) & (F.length("atc_b") >= n)

    level = F.when(same(7), 1).when(same(5), 2).otherwise(3)
    exc = F.when(level > 1, exception_code(F.col("atc_a")))
    return pairs.select(*keys, "atc_a", "atc_b", level.alias("level"), exc.alias("exception_code"), exc.isNotNull().alias("allowed"))


def fuse_levels(df: DataFrame) -> DataFrame:
    """Level of rule and model together: the higher one; a duplicate lifts to Yellow, a contraindication to Red."""
    code = F.greatest(level_code(F.col("rule_level")), level_code(F.col("model_level")), F.when(F.col("has_duplicate"), 2).otherwise(0), F.when(F.col("contraindicated") >= 1, 3).otherwise(0))
    return df.withColumn("fused_level", level_name(code)).withColumn("disagree", F.col("rule_level") != F.col("model_level"))


def probability_level(p: Column, red: float = 0.7, yellow: float = 0.4, green: float = 0.2) -> Column:
    return F.when(p >= red, "Red").when(p >= yellow, "Yellow").when(p >= green, "Green").otherwise("Normal")


def two_stage(p_red: Column, subtype: Column, tau_red: float, tau_review: float) -> tuple[Column, Column]:
    """(decision, action): Red, the review band, or the second stage's subtype."""
    decision = F.when(p_red >= tau_red, "Red").when(p_red >= tau_review, "REVIEW").otherwise(subtype)
    action = F.when(decision == "Red", "immediate").when(decision == "REVIEW", "pharmacist_review").when(decision == "Y_DDI_MAJOR", "call").when(decision == "Y_TRIPLE", "message").otherwise("monitor")
    return decision, action


# Classes of the second stage, in their order.
STAGE2 = ["Y_TRIPLE", "Y_DOUBLE", "Y_DDI_MAJOR", "Y_DDI_MOD", "Y_DUP", "Y_FRAG", "No_Alert"]


def global_probabilities(local: Column, present: list[str], classes: list[str] | None = None) -> Column:
    """A model's probabilities, which come in the order of the classes it was trained on, in the order of all classes.

    Classes that the model doesn't know have 0. Unknown or repeated names raise here, an array of another length
    raises in its row; a null array stays null.
    """
    classes = STAGE2 if classes is None else classes
    if len(set(present)) < len(present) or not set(present) <= set(classes):
        raise ValueError(f"classes {present} repeat or aren't all among {classes}")
    place = {c: k for k, c in enumerate(present)}
    whole = F.array(*(local[place[c]].cast("double") if c in place else F.lit(0.0) for c in classes))
    wrong = F.raise_error(F.concat(F.lit(f"{len(present)} probabilities are wanted, there are "), F.size(local).cast("string"))).cast("array<double>")
    return F.when(local.isNull(), F.lit(None).cast("array<double>")).when(F.size(local) == len(present), whole).otherwise(wrong)


def likeliest(probabilities: Column, classes: list[str] | None = None) -> Column:
    """The class of greatest probability, the first of equals."""
    names = F.array(*(F.lit(c) for c in (STAGE2 if classes is None else classes)))
    return F.get(names, (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int"))


def higher_pairs(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's unordered pairs of names (a_name, b_name, severity) once, with the highest severity, and counts.

    Names compare in lower case without outer blanks; pairs of one name drop. `n_contraindicated` to `n_minor` count a
    key's pairs by their severity after merging.
    """
    from .knowledge import SEVERITIES, rank, severity

    a, b = (F.lower(F.trim(c)) for c in ("a_name", "b_name"))
    named = pairs.select(*keys, F.least(a, b).alias("name_lo"), F.greatest(a, b).alias("name_hi"), rank(F.col("severity")).alias("r")).where("name_lo <> name_hi")
    best = named.groupBy(*keys, "name_lo", "name_hi").agg(F.max("r").alias("r"))
    w = Window.partitionBy(*keys)
    counts = {f"n_{s.lower()}": F.count_if(F.col("r") == k).over(w) for k, s in reversed(list(enumerate(SEVERITIES, 1)))}
    return best.withColumns(counts).select(*keys, "name_lo", "name_hi", severity(F.col("r")).alias("severity"), *counts)


def switch_or_duplicate(days: Column, same_class: Column) -> Column:
    """1 to 6 days together is a switch, 30 or more in one class a duplicate."""
    return F.when(days.between(1, 6), "switch").when((days >= 30) & same_class, "duplicate").otherwise("overlap")


# Classes outside the count of drugs taken at once.
NOT_COUNTED = ["D", "S", "J07", "V"]


def eligible(rx: DataFrame, min_days: int = 8) -> DataFrame:
    """Lines of at least `min_days` outside topical, eye and ear, vaccine and diagnostic classes."""
    return rx.where((F.col("total_days") >= min_days) & ~in_group(F.lit(""), F.col("atc_code"), ([], NOT_COUNTED)))
