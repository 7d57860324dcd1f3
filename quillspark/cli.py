"""The command: ``python -m quillspark.cli parse FILE`` (``-``: standard input) prints a record as JSON; ``capabilities`` what can be parsed.

A record or an error document is one JSON object, on standard output or standard error; exit codes follow the error's code.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from quillspark.operators.normalizing import PARSER_VERSION
from quillspark.operators.profiles import capabilities
from quillspark.schemas import EXIT_CODE, FORMATS, OCR_MODES


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillspark")
    top.add_argument("--version", action="version", version=PARSER_VERSION)
    commands = top.add_subparsers(dest="command", required=True)
    parse = commands.add_parser("parse", help="parse one document")
    parse.add_argument("file", help="a path, or - for standard input")
    parse.add_argument("--hint", choices=[*FORMATS, "auto"], default="auto")
    parse.add_argument("--ocr-mode", choices=OCR_MODES, default="auto")
    parse.add_argument("--pretty", action="store_true", help="indent the JSON")
    commands.add_parser("capabilities", help="say what can be parsed")
    return top


def parse_one(spark, content: bytes, filename: str | None, hint: str, mode: str, **options) -> dict:
    """The record or error document of one document, as a dictionary."""
    from pyspark.sql import functions as F

    from quillspark.plans.parse import parse_documents
    from quillspark.sources.documents import read_bytes

    doc = read_bytes(spark, content, filename).withColumns({"hint_type": F.lit(hint), "ocr_mode": F.lit(mode)})
    row = parse_documents(doc, **options).first().asDict(recursive=True)
    names = ("status", "data", "engine") if row["status"] == "ok" else ("status", "code", "message", "document_type", "engine")
    return {n: row[n] for n in names}


def main(argv: list[str] | None = None, **options) -> int:
    """Runs the command and gives its exit code. options: of ``parse_documents``, such as a text layer."""
    args = arguments().parse_args(argv)
    if args.command == "capabilities":
        print(json.dumps(capabilities(options.get("ocr_vendor")), ensure_ascii=False, indent=2))
        return 0
    if args.file == "-":
        content, name = sys.stdin.buffer.read(), None
    elif Path(args.file).is_file():
        content, name = Path(args.file).read_bytes(), args.file
    else:
        print(f"no such file: {args.file}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    said = parse_one(spark, content, name, args.hint, args.ocr_mode, **options)
    good = said["status"] == "ok"
    print(json.dumps(said, ensure_ascii=False, indent=2 if args.pretty else None), file=sys.stdout if good else sys.stderr)
    return 0 if good else EXIT_CODE.get(said["code"], 1)


if __name__ == "__main__":
    raise SystemExit(main())
