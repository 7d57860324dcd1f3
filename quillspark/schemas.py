"""Types of the records that parsing gives, and the fixed names of formats, types and codes."""

# Names that callers see.
FORMATS = ["pdf", "ofd", "image"]
DOCUMENT_TYPES = ["pdf-fapiao", "pdf-rail-12306", "ofd-air-itinerary", "image-air-itinerary", "ofd-fapiao", "image-fapiao"]
INVOICE_TYPES = ["digital_general", "digital_special", "rail_12306", "air_itinerary"]
OCR_MODES = ["auto", "disabled", "required"]
ERROR_CODES = ["invalid_input", "unsupported_format", "rule_unhandled", "parse_failed", "not_implemented", "internal_error"]
HTTP_STATUS = {"invalid_input": 400, "unsupported_format": 415, "rule_unhandled": 422, "parse_failed": 422, "not_implemented": 501, "internal_error": 500}
EXIT_CODE = {"invalid_input": 2, "unsupported_format": 3, "rule_unhandled": 4, "parse_failed": 4, "not_implemented": 5, "internal_error": 1}

PARTY = "struct<name:string,tax_id:string,address:string,bank:string>"
ITEM = "struct<name:string,spec:string,unit:string,quantity:string,unit_price:string,amount:string,tax_rate:string,tax_amount:string>"
RAIL = "struct<passenger_name:string,id_no_masked:string,train_no:string,from_station:string,to_station:string,depart_time:string,seat_type:string>"
AIR = (
    "struct<passenger_name:string,id_no_masked:string,e_ticket_number:string,flight_no:string,carrier:string,cabin_class:string,"
    "from_station:string,to_station:string,depart_time:string,fare:string,fuel_surcharge:string,civil_aviation_fund:string,"
    "other_taxes:string,tax_rate:string>"
)
SOURCE = "struct<format:string,parser_version:string,extracted_by:string,ocr_vendor:string>"
RAW = (
    "struct<document_type:string,invoice_type:string,invoice_number:string,invoice_code:string,issue_date:string,"
    f"seller:{PARTY},buyer:{PARTY},items:array<{ITEM}>,amount_without_tax:string,tax_amount:string,amount_with_tax:string,"
    f"amount_in_words:string,remark:string,checksum:string,extra:struct<rail_12306:{RAIL},air_itinerary:{AIR}>>"
)
DATA = RAW[:-1] + f",source:{SOURCE}>"
ERROR = "struct<code:string,message:string,document_type:string,invoice_type:string,ocr_required:boolean>"
ENGINE = "struct<rule_engine:string,ocr_mode:string,ocr_enabled:boolean,ocr_used:boolean,ocr_required:boolean,ocr_vendor:string>"
MAX_BYTES = 10 * 1024 * 1024
