"""Word lists, option lists and field catalogue. Everything here is small, static and lives on the driver."""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values: results depend on these exact strings. -------------------------------------------------------------
SENTINELS = (
    "NO_ADVERSE_EVENTS_FOUND", "NO_TEXT_FOUND", "SECTION_NOT_FOUND", "EXTRACTION_FAILED", "CONTENT_EXTRACTION_FAILED",
    "TEXT_EXTRACTION_ERROR", "SUMMARY_GENERATION_FAILED", "******", "********",
)
EMPTY_PREFIXES = (
    "error", "no_text_found", "section_not_found", "extraction_failed", "content_extraction_failed", "summary_generation_failed",
    "no_adverse_events_found", "no date available", "no information", "not present in source", "unable to determine", "******", "********",
)
PROSE_MARKERS = (
    "the text you provided", "the text provided", "it appears you", "you've provided", "you have provided", "here's a summary",
    "here is a summary", "here's the", "here is the", "in summary", "to summarize", "i recommend", "please note", "please consult",
    "consulting the original", "healthcare professional", "for more detailed information", "based on the text", "the following is",
    "this text describes", "is a summary of",
)
LEADING_LABEL = r"(adverse\s+events?|adverse\s+reactions?|indications?(\s+of\s+use)?|contraindications?|drug\s+interactions?|drugs?|conditions?|keywords?|output|answer|result)"
LIVER_OPTIONS = (
    "Use with caution in liver impairment", "No dose adjustment required for liver impairment",
    "Dose adjustment recommended with liver impairment", "Contraindicated in patients with liver impairment",
)
KIDNEY_OPTIONS = (
    "Use with caution in kidney impairment", "No dose adjustment required for kidney impairment",
    "Dose adjustment recommended with kidney impairment", "Contraindicated in patients with kidney impairment",
)
PREGNANCY_OPTIONS = ("CONTRANDICATED", "NOT RECOMMENDED", "USE WITH CAUTION", "NO INFORMATION")
BREASTFEEDING_OPTIONS = ("CONTRANDICATED", "NOT RECOMMENDED", "USE WITH CAUTION", "CONSIDERED SAFE", "NO INFORMATION")
COMPANY_STOP_WORDS = (
    "inc", "ltd", "limited", "limitee", "ltee", "incorporated", "corp", "corporation", "co", "the", "canada", "pharma",
    "pharmaceuticals", "pharmaceutical", "ulc", "ltd.", "llc", "gmbh", "sa", "ag",
)
NAME_ALIASES = {"cephalexin": "cefalexin", "amoxicillin": "amoxicillin trihydrate"}
MISSING = ("ERROR", "NO_TEXT_FOUND", "SECTION_NOT_FOUND", "EXTRACTION_FAILED")
# --- End of fixed values. ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    """One column of the published record: internal name, kind, and its headers in the record and the evaluation tables."""

    name: str
    kind: str
    record: str
    evaluation: str | None = None


# --- Fixed values: the record's columns and their headers. ----------------------------------------------------------------
RECORD_FIELDS = (
    Field("id", "key", "ID"),
    Field("brand_name", "text", "Brand Name"),
    Field("company", "text", "Company"),
    Field("initial_authorization", "date", "Initial Authorization"),
    Field("revision_date", "date", "Revision Date"),
    Field("ingredients", "text", "Ingredients"),
    Field("dosage", "text", "Dosage"),
    Field("indications", "list", "Indications", "Indication of Use"),
    Field("contraindications", "list", "Contraindications"),
    Field("serious_warnings", "list", "Serious Warnings", "Serious warning and precautions"),
    Field("adverse_events", "list", "Adverse Events"),
    Field("drug_interactions", "list", "Drug Interactions"),
    Field("liver_dose", "categorical", "Liver Dose Adjustment", "Liver Function Dose Adjustment"),
    Field("kidney_dose", "categorical", "Kidney Dose Adjustment", "Kidney Function Dose Adjustment"),
    Field("pharmacokinetics", "freetext", "Pharmacokinetics"),
    Field("metabolism", "freetext", "Metabolism"),
    Field("elimination", "freetext", "Elimination"),
    Field("pharmacodynamics", "freetext", "Pharmacodynamics"),
    Field("pregnancy_status", "categorical", "Pregnancy Recommendation"),
    Field("pregnancy_summary", "freetext", "Pregnancy Summary"),
    Field("breastfeeding_status", "categorical", "Breastfeeding Recommendation"),
    Field("breastfeeding_summary", "freetext", "Breastfeeding Summary"),
)
PROVENANCE = ("Source Path", "Drug Folder", "Therapeutic Class")
# --- End of fixed values. ---------------------------------------------------------------------------------------------


def record_order() -> list[str]:
    return [f.record for f in RECORD_FIELDS] + list(PROVENANCE)


def by_kind(kind: str) -> list[Field]:
    return [f for f in RECORD_FIELDS if f.kind == kind]
