"""The safety filter: any match of an ordered set of patterns replaces the whole text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names and patterns in the order in which matches are listed.
PATTERNS = [
    ("diagnosis_is", r"\b(the\s+)?diagnosis\s+is\b"),
    ("you_have_condition", r"\byou\s+have\s+(a\s+)?(fracture|sprain|concussion|infection|dislocation|hypothermia|frostbite|heat\s*stroke|pneumonia|stroke|heart\s+attack)\b"),
    ("patient_has_grade", r"\b(patient|victim)\s+has\s+(a\s+)?(grade[-\s]?\d+|severe|mild|moderate)\b"),
    ("this_is_a_grade", r"\bthis\s+is\s+(a\s+)?(grade[-\s]?\d+\s+)?(fracture|sprain|concussion|dislocation)\b"),
    ("prescribe_take_drug", r"\b(take|administer|give|prescribe)\s+\d+(\.\d+)?\s*(mg|mcg|ml|g)\b"),
    ("named_drug_dose", r"\b(ibuprofen|acetaminophen|aspirin|morphine|epinephrine|naloxone|antibiotics?)\s+\d+(\.\d+)?\s*(mg|mcg|ml)\b"),
    ("you_should_take", r"\byou\s+should\s+(take|be\s+given)\s+\w+"),
    ("i_diagnose", r"\bi\s+(diagnose|diagnosed)\b"),
    ("my_diagnosis", r"\bmy\s+diagnosis\b"),
    ("dose_per_kg", r"\b\d+(?:\.\d+)?\s*(?:mg|mcg|ug|µg|g|ml)\s*/\s*kg\b"),
    ("drug_with_dose", r"\b(?:ibuprofen|acetaminophen|paracetamol|aspirin|morphine|fentanyl|ketamine|midazolam|diazepam|lorazepam|naloxone|narcan|epinephrine|adrenaline|diphenhydramine|ondansetron|tranexamic|txa|ketorolac|antibiotics?|analgesics?)\b[^.]{0,40}?\b\d+(?:\.\d+)?\s*(?:mg|mcg|ug|µg|g|ml)\b"),
    ("dose_with_route", r"\b\d+(?:\.\d+)?\s*(?:mg|mcg|ug|µg|g|ml)\b[^.]{0,24}?\b(?:IV|IM|IO|PO|SL|SC|SQ|buccal|intranasal|sublingual)\b"),
    ("species_id", r"(?<!if )(?<!whether )\b(this|that|it)(?:\s+(?:is|was|must\s+be)|'s)\s+(an?\s+)?(?:[a-z]+[-\s]){0,2}(rattlesnake|copperhead|cottonmouth|water\s+moccasin|coral\s+snake|black\s+widow|brown\s+recluse|poison\s+(ivy|oak|sumac)|hogweed|hemlock|death\s+cap|nettle|grizzly|black\s+bear|brown\s+bear|mountain\s+lion|cougar|puma|moose|tick|spider|snake|mushroom|berry)\b"),
    ("harmless_reassurance", r"\b(is|are|it'?s|that'?s)\s+(an?\s+)?(probably\s+|likely\s+|definitely\s+|most\s+likely\s+)?(harmless|non-?venomous|non-?poisonous|not\s+(venomous|poisonous|dangerous))\b"),
    ("edibility_advice", r"\b(safe|ok|okay|fine)\s+to\s+eat\b|\b(is|are)\s+edible\b|\byou\s+can\s+eat\b|\buniversal\s+edibility\s+test\b"),
]
REPLACEMENT = "Displaying retrieved protocol checklist. This assistant does not diagnose conditions, prescribe treatments, identify species, or advise on what is safe to eat. Compare against the reference images yourself, and follow only the cited field-manual steps within your training and scope."

#: ASCII and Unicode cases fold alike, as do their classes.
FLAGS = "(?iU)"


#: What a text must hold for a pattern to match: of every group one. Lower-case; a digit stands for any.
REQUIRED = {
    "diagnosis_is": [["diagnosis"]],
    "you_have_condition": [["you"], ["have"], ["fracture", "sprain", "concussion", "infection", "dislocation", "hypothermia", "frostbite", "stroke", "pneumonia", "attack"]],
    "patient_has_grade": [["patient", "victim"], ["has"], ["grade", "severe", "mild", "moderate"]],
    "this_is_a_grade": [["this"], ["fracture", "sprain", "concussion", "dislocation"]],
    "prescribe_take_drug": [["take", "administer", "give", "prescribe"], ["0"]],
    "named_drug_dose": [["ibuprofen", "acetaminophen", "aspirin", "morphine", "epinephrine", "naloxone", "antibiotic"], ["0"]],
    "you_should_take": [["you"], ["should"], ["take", "given"]],
    "i_diagnose": [["diagnose"]],
    "my_diagnosis": [["diagnosis"]],
    "dose_per_kg": [["kg"], ["/"], ["0"]],
    "drug_with_dose": [["ibuprofen", "acetaminophen", "paracetamol", "aspirin", "morphine", "fentanyl", "ketamine", "midazolam", "diazepam", "lorazepam", "naloxone", "narcan", "epinephrine", "adrenaline", "diphenhydramine", "ondansetron", "tranexamic", "txa", "ketorolac", "antibiotic", "analgesic"], ["0"]],
    "dose_with_route": [["0"], ["iv", "im", "io", "po", "sl", "sc", "sq", "buccal", "intranasal", "sublingual"]],
    "species_id": [["this", "that", "it"], ["snake", "copperhead", "cottonmouth", "moccasin", "widow", "recluse", "poison", "hogweed", "hemlock", "death", "nettle", "grizzly", "bear", "mountain", "cougar", "puma", "moose", "tick", "spider", "mushroom", "berry"]],
    "harmless_reassurance": [["harmless", "venomous", "poisonous", "dangerous"]],
    "edibility_advice": [["eat", "edible", "edibility"], ["safe", "ok", "fine", "edible", "can", "universal"]],
}
#: Characters that are equal to an ASCII letter when cases fold, and their letters.
FOLDED = ("\u0130\u0131\u017f\u212a", "iisk")


def assert_compiles(spark: SparkSession) -> int:
    """Every pattern compiles in the engine that runs it; a filter that lost one would pass what it should block."""
    return len(spark.range(1).select(*(F.lit("").rlike(FLAGS + p) for _, p in PATTERNS)).first())


def could_match(folded: Column, name: str) -> Column:
    """Whether a text (lower-case, its foldings made plain) holds what a pattern needs."""
    needs = [reduce(Column.__or__, [folded.rlike(r"(?U)\d") if x == "0" else folded.contains(x) for x in group]) for group in REQUIRED[name]]
    return reduce(Column.__and__, needs)


def matched_patterns(text: Column) -> Column:
    """Names of the patterns that match, in their order.

    The text is lowered once; a pattern is tried only on a text that holds what it requires.
    """
    tried = lambda t: F.array(*(F.when(could_match(t, n) & text.rlike(FLAGS + p), F.lit(n)) for n, p in PATTERNS))
    folded = F.lower(F.translate(text, *FOLDED))
    return F.filter(F.flatten(F.transform(F.array(folded), tried)), lambda x: x.isNotNull())


def sanitize(df: DataFrame, column: str = "text") -> DataFrame:
    """df with safe_text, was_modified and matched_patterns. A null text stays null and unmodified."""
    out = df.withColumn("matched_patterns", matched_patterns(F.coalesce(F.col(column), F.lit(""))))
    out = out.withColumn("was_modified", F.size("matched_patterns") > 0)
    return out.withColumn("safe_text", F.when(F.col("was_modified"), F.lit(REPLACEMENT)).otherwise(F.col(column)))


def sanitize_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Every named output column passed through the filter, error texts included."""
    for c in columns:
        df = df.withColumn(c, F.when(F.size(matched_patterns(F.coalesce(F.col(c), F.lit("")))) > 0, F.lit(REPLACEMENT)).otherwise(F.col(c)))
    return df
