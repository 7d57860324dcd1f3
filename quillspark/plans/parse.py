"""Parsing of documents: one plan from bytes or texts to records, with errors as data.

Rows go through acquisition, quality gate, routing, extraction and normalisation as columns of one plan. An input
without bytes has no Python stage. Each layout's expressions act on its own rows only, and bytes never reach a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions.text import contains_any, filled_lines, half_width, lines, trimmed_lines
from quillspark.operators.air import air_from_fields, air_from_text, is_air_fields
from quillspark.operators.invoice_fields import invoice_code, invoice_number, issue_date, issuer, parties, price_and_tax, totals
from quillspark.operators.invoice_items import items
from quillspark.operators.normalizing import normalized
from quillspark.operators.answers import answer_lines
from quillspark.operators.payloads import lines_text, metadata_record, qr_record
from quillspark.operators.rail import rail
from quillspark.operators.records import party, raw
from quillspark.operators.routing import layout, looks_like_invoice, too_short, unusable_text
from quillspark.schemas import ENGINE, ERROR, EXIT_CODE, HTTP_STATUS, MAX_BYTES, OCR_MODES, RAW
from quillspark.sources.documents import container_images, hinted_format, open_bytes, provided, sniffed_format, with_metadata

_OPTIONAL = {
    "index": "long", "filename": "string", "hint_type": "string", "ocr_mode": "string", "format": "string", "text": "string", "qr_payload": "string",
    "ocr_text": "string", "fields": "map<string,string>", "container_text": "string", "image_text": "string", "metadata": "map<string,string>",
    "broken_container": "boolean", "ocr_lines": "array<struct<text:string>>", "ocr_payload": "string", "n_images": "int"}
# Words that tell a container with an invoice.
CONTAINER_MARKERS = ["电子发票", "普通发票", "专用发票", "发票号码", "InvoiceNumber", "InvoiceCode", "TotalTax-includedAmount"]
# Messages are ours; callers act on codes.
MESSAGES = {
    "empty": "the document is empty", "large": "the document exceeds the size limit", "mode": "ocr_mode must be auto, disabled or required",
    "hint": "hint_type must be pdf, ofd, image or auto", "format": "the format is not known", "no_ocr": "OCR is needed but no OCR is configured",
    "ocr_off": "OCR is needed but this call disables it", "broken": "the container cannot be opened", "ofd_invoice": "an OFD invoice is recognised but not read",
    "ofd_other": "only air itineraries are read from OFD", "short": "too little text was recognised", "layout": "no layout fits the text",
    "qr": "the QR payload has no invoice number", "failed": "a function that was to read the document failed", "answer": "the answer of the OCR service has no text", "unread": "rules cannot read this PDF: no usable text, metadata or QR payload, or an unknown layout"}


def _error(code: str, message: str, document_type: str | None = None, ocr_required: bool = False) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(MESSAGES[message]).alias("message"), F.lit(document_type).alias("document_type"),
                    F.lit(None).alias("invoice_type"), F.lit(ocr_required).alias("ocr_required")).cast(ERROR)


_built: dict = {}


def _once(name: str, build: Callable[[], Column]) -> Column:
    """The expression ``name``, built once a Spark application: its inputs are columns of fixed names."""
    key = (SparkContext._active_spark_context.applicationId, name)
    if key not in _built:
        _built[key] = build()
    return _built[key]


def _held(value: Column) -> Column:
    """``value``, into which the optimiser substitutes nothing from above.

    A filter on a record (also the one that ``explode`` implies) would be pushed through all steps of the plan, and its copy of
    their expressions doubles at each: planning never ends. Filters do not pass columns that count as nondeterministic.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def _with_inputs(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(t) for c, t in _OPTIONAL.items() if c not in df.columns})


def _invoice_columns(df: DataFrame) -> DataFrame:
    """The parts of general and special invoices, null for other rows."""
    mine = F.col("layout").isin("general", "special")
    df = df.withColumn("__t", F.when(mine, half_width(F.col("__read"))))
    df = df.withColumn("__lines", lines(F.col("__t")))
    df = df.withColumn("__trimmed", _once("trimmed", lambda: trimmed_lines(F.col("__lines"))))
    df = df.withColumn("__filled", _once("filled", lambda: F.filter("__trimmed", lambda x: x != "")))
    t, rows, filled = F.col("__t"), F.col("__trimmed"), F.col("__filled")
    parts = {"__parties": lambda: parties(t, filled), "__totals": lambda: totals(t, filled), "__gross": lambda: price_and_tax(t, rows),
             "__items": lambda: items(rows)}
    return df.withColumns({k: F.when(mine, _once(k, v)) for k, v in parts.items()})


def _invoice_record() -> Column:
    t, rows = F.col("__t"), F.col("__trimmed")
    return raw(
        invoice_type=F.when(F.col("layout") == "special", "digital_special").otherwise("digital_general"), invoice_number=invoice_number(t, rows),
        invoice_code=invoice_code(t, rows), issue_date=issue_date(t), seller=party(F.col("__parties.seller"), F.col("__parties.seller_id")),
        buyer=party(F.col("__parties.buyer"), F.col("__parties.buyer_id")), items=F.col("__items"), amount_without_tax=F.col("__totals.first"),
        tax_amount=F.col("__totals.second"), amount_with_tax=F.col("__gross.second"), amount_in_words=F.col("__gross.first"),
        remark=F.concat(F.lit("开票人:"), issuer(t)))


def parse_documents(
    df: DataFrame, *, ocr_vendor: str | None = None, max_bytes: int = MAX_BYTES, trust_extension: bool = False,
    text_layer: Callable[[bytes], str | None] | None = None, qr_reader: Callable[[bytes], str | None] | None = None,
    ocr: Callable[[bytes], str | None] | None = None,
) -> DataFrame:
    """One row a document: its own columns but the inputs, and format, layout, status, code, message, document_type, data, engine.

    Inputs, all optional: content (bytes), text (its text layer), qr_payload, ocr_text, ocr_lines (array of struct with text),
    ocr_payload (the JSON answer of an OCR service), fields, container_text, metadata, hint_type, ocr_mode, filename, index.
    ``ocr_vendor`` names the OCR behind the texts; without a name OCR counts as not configured. ``text_layer``, ``qr_reader``
    and ``ocr`` fill missing texts from the bytes of only those rows that reach them, ``ocr`` also from the images in
    containers; one that raises makes its row an internal_error. An OCR answer without text is a parse_failed.
    Filters on the result are not pushed below the parsing: filter documents by their own columns before.
    """
    has_bytes = "content" in df.columns
    # layouts, sums and so on of texts that no row can have are no part of the plan
    has_layer = "text" in df.columns or has_bytes and text_layer is not None
    may_read = has_layer or bool({"ocr_text", "ocr_lines", "ocr_payload"} & set(df.columns)) or has_bytes and ocr is not None
    may_hold = {"__ofd": has_bytes or "fields" in df.columns, "__meta": has_bytes or "metadata" in df.columns, "__qr": "qr_payload" in df.columns or has_bytes and qr_reader is not None}
    # a PDF that only its bytes or a hint tell needs no opened container, so the pass that opens those reads its text too
    reads_first = has_bytes and text_layer is not None and not trust_extension
    if has_bytes:
        given = [c for c in ("fields", "metadata", "container_text", "broken_container", "n_images") if c in df.columns]
        df = df.drop(*given)
        if reads_first:
            hint, mode = (F.col(c) if c in df.columns else F.lit(None).cast("string") for c in ("hint_type", "ocr_mode"))
            is_pdf = hinted_format(hint, sniffed_format(F.col("content"), F.lit(False))) == "pdf"
            readable = (F.col("byte_count") > 0) & (F.col("byte_count") <= max_bytes) & F.coalesce(mode, F.lit("auto")).isin(*OCR_MODES)
            df = open_bytes(df, max_bytes, text_layer, readable & is_pdf)
        else:
            df = open_bytes(df, max_bytes)
    has_answers = "ocr_payload" in df.columns
    df = _with_inputs(df)
    df = df if reads_first else df.withColumn("__failed", F.lit(None).cast("string"))
    answered = F.col("ocr_payload").isNotNull()
    answer = F.array_join(answer_lines("ocr_payload"), "\n") if has_answers else F.lit(None).cast("string")
    df = df.withColumn("ocr_text", F.coalesce("ocr_text", lines_text(F.col("ocr_lines")), answer))
    mode = F.coalesce("ocr_mode", F.lit("auto"))
    may_ocr = F.lit(ocr_vendor is not None) & (mode != "disabled")
    if has_bytes:
        named = F.col("filename") if trust_extension else None
        sniffed = sniffed_format(F.col("content"), F.col("is_ofd"), named)
    else:
        sniffed = F.coalesce("format", F.lit("pdf"))
    df = df.withColumn("format", hinted_format(F.col("hint_type"), sniffed))
    form = F.col("format")
    none = F.lit(None).cast(ERROR)
    early = F.when(~mode.isin(*OCR_MODES), _error("invalid_input", "mode")).when(form.isNull(), _error("unsupported_format", "hint"))
    early = early.when((form == "image") & (mode == "required") & F.lit(ocr_vendor is None), _error("not_implemented", "no_ocr", None, True))
    early = early.when(form == "unknown", _error("unsupported_format", "format")).otherwise(none)
    if has_bytes:
        size = F.col("byte_count")
        early = F.when(size == 0, _error("invalid_input", "empty")).when(size > max_bytes, _error("invalid_input", "large")).otherwise(early)
    df = df.withColumn("__early", early)
    alive = F.col("__early").isNull()
    if has_bytes and text_layer and not reads_first:
        df = provided(df, "text", alive & (form == "pdf"), text_layer, "__failed")
    df = df.withColumn("__usable", (form == "pdf") & ~_once("unusable", lambda: unusable_text(F.col("text"))) if has_layer else F.lit(False))
    if has_bytes:
        df = with_metadata(df, alive & (form == "pdf") & ~F.col("__usable"))
    has_metadata = F.coalesce(F.size("metadata") > 0, F.lit(False))
    stuck = alive & (form == "pdf") & ~F.col("__usable") & ~has_metadata
    if has_bytes and qr_reader:
        df = provided(df, "qr_payload", stuck, qr_reader, "__failed")
    has_qr = F.coalesce(F.col("qr_payload") != "", F.lit(False))
    if has_bytes and ocr:
        df = provided(df, "ocr_text", may_ocr & (stuck & ~has_qr | alive & (form == "image")), ocr, "__failed")
    recognised = F.coalesce(contains_any(F.concat_ws("\n", F.array_join(F.map_values("fields"), "\n"), "container_text"), CONTAINER_MARKERS), F.lit(False))
    if has_bytes and ocr:
        pictured = may_ocr & alive & (form == "ofd") & ~recognised & ~F.coalesce(is_air_fields(F.col("fields")), F.lit(False)) & (F.col("n_images") > 0)
        df = provided(df, "image_text", pictured, lambda content: "\n".join(x for x in map(ocr, container_images(content)) if x), "__failed")
    recognised = recognised | (may_ocr & contains_any(F.coalesce("image_text", F.lit("")), CONTAINER_MARKERS))
    is_air = F.coalesce(is_air_fields(F.col("fields")), F.lit(False))
    via = (
        F.when(~alive, None).when(F.col("__usable"), "text")
        .when(form == "pdf", F.when(has_metadata, "metadata").when(has_qr, "qr").when(may_ocr, "ocr"))
        .when((form == "image") & may_ocr, "ocr").when((form == "ofd") & is_air, "fields"))
    df = df.withColumn("__via", via)
    df = df.withColumn("__read", F.when(F.col("__via") == "text", F.col("text")).when((F.col("__via") == "ocr") & ~too_short(F.col("ocr_text")), F.col("ocr_text")))
    df = df.withColumn("layout", _once("layout", lambda: layout(F.col("__read"))) if may_read else F.lit(None).cast("string"))
    df = df.withColumn("__qr", F.when(F.col("__via") == "qr", _once("qr", lambda: qr_record(F.col("qr_payload")))) if may_hold["__qr"] else F.lit(None).cast(RAW))
    late = (
        F.when(F.col("__failed").isNotNull(), _error("internal_error", "failed"))
        .when((F.col("__via") == "ocr") & answered & F.col("ocr_text").isNull(), _error("parse_failed", "answer"))
        .when(F.col("layout").isNotNull() | F.col("__via").isin("metadata", "fields"), none)
        .when(F.col("__via") == "qr", F.when(F.col("__qr.invoice_number").isNull(), _error("parse_failed", "qr")))
        .when(form == "image", F.when(mode == "disabled", _error("not_implemented", "ocr_off", None, True))
              .when(F.col("__via").isNull(), _error("not_implemented", "no_ocr", None, True))
              .otherwise(F.when(F.col("__read").isNull(), _error("parse_failed", "short")).otherwise(_error("parse_failed", "layout"))))
        .when(form == "ofd", F.when(F.coalesce("broken_container", F.lit(False)), _error("parse_failed", "broken"))
              .when(recognised, _error("not_implemented", "ofd_invoice", "ofd-fapiao")).otherwise(_error("not_implemented", "ofd_other", None, True)))
        .when(F.col("__via") == "text", F.when(looks_like_invoice(F.col("text")), _error("rule_unhandled", "unread", "pdf-fapiao", True))
              .otherwise(_error("parse_failed", "layout")))
        .when(F.col("__via") == "ocr", F.when(F.col("__read").isNull(), _error("parse_failed", "short")).otherwise(_error("parse_failed", "layout")))
        .otherwise(_error("rule_unhandled", "unread", "pdf-fapiao", True)))
    df = df.withColumn("__error", _held(F.coalesce("__early", late)))
    df = _invoice_columns(df) if may_read else df
    read = F.col("__read")
    records = {
        "__invoice": (F.col("layout").isin("general", "special"), _invoice_record), "__rail": (F.col("layout") == "rail", lambda: rail(read)),
        "__air": (F.col("layout") == "air", lambda: air_from_text(read, filled_lines(lines(read)))),
        "__ofd": (F.col("__via") == "fields", lambda: air_from_fields(F.col("fields"))),
        "__meta": (F.col("__via") == "metadata", lambda: metadata_record(F.col("metadata"), F.col("text")))}
    records = {k: r for k, r in records.items() if may_hold.get(k, may_read)}
    df = df.withColumns({k: F.when(where, _once(k, build)) for k, (where, build) in records.items()})
    df = df.withColumn("__raw", F.coalesce(*records, "__qr"))
    by = F.when(F.col("__via") == "ocr", "ocr").when(F.col("__via") == "qr", "qrcode").otherwise("text_layer")
    vendor = F.when(F.col("__via") == "ocr", F.lit(ocr_vendor))
    ok = F.col("__error").isNull()
    df = df.withColumn("data", _held(F.when(ok, _once(f"data {ocr_vendor}", lambda: normalized(F.col("__raw"), form, by, vendor)))))
    code = F.col("__error.code")
    engine = F.struct(
        F.lit("attempted").alias("rule_engine"), F.when(mode.isin(*OCR_MODES), mode).otherwise("auto").alias("ocr_mode"),
        F.lit(ocr_vendor is not None).alias("ocr_enabled"), (ok & F.coalesce(F.col("__via") == "ocr", F.lit(False))).alias("ocr_used"),
        F.coalesce("__error.ocr_required", F.lit(False)).alias("ocr_required"),
        F.when(ok, vendor).when(code == "rule_unhandled", F.lit(ocr_vendor)).alias("ocr_vendor")).cast(ENGINE)
    df = df.withColumns({
        "status": F.when(ok, "ok").otherwise("error"), "code": code, "message": F.col("__error.message"), "engine": engine,
        "document_type": F.coalesce(F.col("data.document_type"), F.col("__error.document_type"))})
    gone = {"content", "text", "qr_payload", "ocr_text", "fields", "container_text", "image_text", "metadata", "broken_container", "is_ofd",
            "ocr_lines", "ocr_payload", "n_images", "byte_count", "ocr_mode", "hint_type", "length"}
    return df.select(*[c for c in df.columns if not c.startswith("__") and c not in gone])


def _lookup(code: Column, table: dict[str, int], default: int) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[code], F.lit(default))


def http_status(code: Column) -> Column:
    return F.when(code.isNull(), 200).otherwise(_lookup(code, HTTP_STATUS, 500))


def exit_code(code: Column) -> Column:
    return F.when(code.isNull(), 0).otherwise(_lookup(code, EXIT_CODE, 1))


def batch_summary(parsed: DataFrame) -> DataFrame:
    """One row: total, succeeded, failed."""
    good = F.count_if(F.col("status") == "ok")
    return parsed.agg(F.count("*").alias("total"), good.alias("succeeded"), (F.count("*") - good).alias("failed"))


def error_documents(parsed: DataFrame) -> DataFrame:
    """The failed rows as JSON error documents."""
    body = F.struct("status", "code", "message", "document_type", "engine")
    return parsed.where(F.col("status") == "error").select("index", "filename", F.to_json(body).alias("error"))


def to_json(parsed: DataFrame) -> DataFrame:
    """Good records as JSON with null fields kept."""
    return parsed.where(F.col("status") == "ok").select("index", "filename", F.to_json("data", {"ignoreNullFields": "false"}).alias("json"))
