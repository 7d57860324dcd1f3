"""Model profiles of local OCR, and what the engine can do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspark.operators.normalizing import PARSER_VERSION
from quillspark.schemas import DOCUMENT_TYPES, INVOICE_TYPES, OCR_MODES

# Profile, model that finds lines, model that reads them; other names of the default profile.
DEFAULT_PROFILE = "invoice-lite"
PROFILES = [
    ("invoice-lite", "ch_PP-OCRv5_det", "doc-densenet_lite_136-gru"), ("general-lite", "ch_PP-OCRv5_det", "densenet_lite_136-gru"),
    ("scene-lite", "ch_PP-OCRv5_det", "scene-densenet_lite_136-gru"), ("mobile-lite", "ch_PP-OCRv5_det", "ch_ppocr_mobile_v2.0")]
ALIASES = ["default", "invoice", "doc"]
BACKEND = "onnx"


def profile_table(spark: SparkSession) -> DataFrame:
    """(profile, det_model, rec_model, det_backend, rec_backend), one row a profile."""
    return spark.createDataFrame([(*p, BACKEND, BACKEND) for p in PROFILES], "profile string, det_model string, rec_model string, det_backend string, rec_backend string")


def profile_name(name: Column) -> Column:
    """The profile that a name or another name of it means; the default for null and empty ones; null for unknown names."""
    clean = F.trim(name)
    known = {p: p for p, *_ in PROFILES} | dict.fromkeys(ALIASES, DEFAULT_PROFILE)
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit(DEFAULT_PROFILE)).otherwise(table[clean])


def resolved(name: str | None) -> dict[str, str]:
    """The profile of a name as a dictionary. Raises ValueError for unknown names."""
    clean = (name or DEFAULT_PROFILE).strip()
    for profile, det, rec in PROFILES:
        if profile == (DEFAULT_PROFILE if clean in ALIASES else clean):
            return {"profile": profile, "det_model": det, "rec_model": rec, "det_backend": BACKEND, "rec_backend": BACKEND}
    raise ValueError(f"no OCR profile {name!r}; there are {', '.join(sorted(p for p, *_ in PROFILES))}")


def capabilities(ocr_vendor: str | None = None, local_ocr: bool = False, profile: str | None = None) -> dict:
    """What documents can be parsed. local_ocr: the vendor is a local engine, described by its ``profile``."""
    modes = {"auto": "rules first; OCR where it is needed and configured", "disabled": "rules only", "required": "images need a configured OCR"}
    out: dict = {
        "version": PARSER_VERSION.rpartition("-")[2],
        "formats": {"pdf": "supported", "ofd": "partial_supported", "image": "supported" if ocr_vendor else "not_implemented"},
        "document_types": DOCUMENT_TYPES, "invoice_types": INVOICE_TYPES, "parse_modes": {"ocr_mode": {m: modes[m] for m in OCR_MODES}}}
    if local_ocr and ocr_vendor:
        mine = resolved(profile)
        out["ocr"] = {"vendor": ocr_vendor, "model_profile": mine.pop("profile"), **mine, "bundled_models": False,
                      "available_model_profiles": {p: {k: v for k, v in resolved(p).items() if k != "profile"} for p, *_ in PROFILES}}
    return out


def capability_table(spark: SparkSession, ocr_vendor: str | None = None) -> DataFrame:
    """(kind, name, status) of formats, document types, invoice types and modes."""
    known = capabilities(ocr_vendor)
    rows = [("format", k, v) for k, v in known["formats"].items()] + [("document_type", k, "supported") for k in known["document_types"]]
    rows += [("invoice_type", k, "supported") for k in known["invoice_types"]] + [("ocr_mode", k, "supported") for k in known["parse_modes"]["ocr_mode"]]
    return spark.createDataFrame(rows, "kind string, name string, status string")
