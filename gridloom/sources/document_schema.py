"""The schemas of documents and of templates. Names, types and bounds are fixed values of the two formats."""

from __future__ import annotations

ADDRESS, RANGE = "^[A-Z]+[1-9][0-9]*$", "^[A-Z]+[1-9][0-9]*:[A-Z]+[1-9][0-9]*$"
REGION_TYPES = ["metadata", "key_value", "table", "freeform", "image", "chart", "layout"]
SEVERITIES = ["info", "warning", "error"]
VERSION = "1.0"

TEXT, FLAG = {"type": "string"}, {"type": "boolean"}
NAME, PATTERN = {"type": "string", "minLength": 1}, {"type": "string", "minLength": 1}
ANY = {"type": "object"}
NAMES = {"type": "object", "additionalProperties": TEXT}


def _whole(least: int | None = None) -> dict:
    return {"type": "integer"} if least is None else {"type": "integer", "minimum": least}


def _list(items: dict) -> dict:
    return {"type": "array", "items": items}


def _record(needed: str, /, **fields: dict) -> dict:
    """An object of these fields alone; needed names the required ones."""
    return {"type": "object", "additionalProperties": False, "required": needed.split(), "properties": fields}


_SOURCE = _record("sheet", sheet=NAME, range={"type": "string", "pattern": RANGE}, cell={"type": "string", "pattern": ADDRESS}, workbook_path=TEXT)
_STYLE = _record("", number_format=TEXT, font=ANY, fill=ANY, border=ANY, alignment=ANY)
_CELL = _record(
    "coordinate row column", coordinate={"type": "string", "pattern": ADDRESS}, row=_whole(1), column=_whole(1), raw_value=True, display_value=TEXT, data_type=TEXT, formula=TEXT,
    style=_STYLE, merged_master={"type": "string", "pattern": ADDRESS}, row_span=_whole(1), col_span=_whole(1), source=_SOURCE,
)
_TABLE = _record("table_id", table_id=NAME, cells=_list(_CELL), source=_SOURCE, header_rows=_whole(0), column_semantics=NAMES, metadata=ANY)
_REGION = _record(
    "region_id region_type", region_id=NAME, region_type={"enum": REGION_TYPES}, title=TEXT, source=_SOURCE, tables=_list(_TABLE), values=ANY, asset_ids=_list(TEXT),
    confidence={"type": "number", "minimum": 0, "maximum": 1}, metadata=ANY,
)
_ASSET = _record(
    "asset_id asset_type uri", asset_id=NAME, asset_type={"enum": ["image", "screenshot", "chart", "shape", "layout"]}, uri=NAME, media_type=TEXT, description=TEXT,
    source=_SOURCE, anchor=TEXT, extraction_status=TEXT, metadata=ANY,
)
_DIAGNOSTIC = _record("code severity message", code=NAME, severity={"enum": SEVERITIES}, message=TEXT, source=_SOURCE, region_id=TEXT, details=ANY)
_SHEET = _record("sheet_id name index", sheet_id=NAME, name=TEXT, index=_whole(0), regions=_list(_REGION), assets=_list(_ASSET), diagnostics=_list(_DIAGNOSTIC), metadata=ANY)
DOCUMENT = _record(
    "document_id title sheets schema_version", schema_version={"const": VERSION}, document_id=NAME, title=TEXT, source_path=TEXT, template_id=TEXT, template_version=TEXT,
    sheets=_list(_SHEET), assets=_list(_ASSET), diagnostics=_list(_DIAGNOSTIC), metadata=ANY,
)

_FINGERPRINT = {
    **_record("", sheet_name_pattern=PATTERN, cells={**NAMES, "propertyNames": {"pattern": ADDRESS}}, required_text=_list(TEXT), weight={"type": "number", "exclusiveMinimum": 0}),
    "anyOf": [{"required": ["cells"], "properties": {"cells": {"minProperties": 1}}}, {"required": ["required_text"], "properties": {"required_text": {"minItems": 1}}}],
}
_MATCH = _record("", sheet_name_patterns=_list(TEXT), fingerprints=_list(_FINGERPRINT), minimum_score={"type": "number", "minimum": 0, "maximum": 1})
_LOCATOR = {
    **_record(
        "mode", mode={"enum": ["fixed", "anchor"]}, range={"type": "string", "pattern": RANGE}, anchor_text=NAME, anchor_pattern=PATTERN, end_anchor_text=NAME, end_anchor_pattern=PATTERN,
        row_offset=_whole(), column_offset=_whole(), height=_whole(1), width=_whole(1), repeat_anchor=FLAG,
    ),
    "allOf": [
        {"if": {"properties": {"mode": {"const": "fixed"}}}, "then": {"required": ["range"]}},
        {"if": {"properties": {"mode": {"const": "anchor"}}}, "then": {"anyOf": [{"required": ["anchor_text"]}, {"required": ["anchor_pattern"]}]}},
    ],
}
_EXTRACTOR = _record(
    "kind", kind={"enum": ["table", "key_value", "freeform", "asset"]}, header_rows=_whole(0), key_column=_whole(1), value_column=_whole(1), key_semantics=NAMES, column_semantics=NAMES, options=ANY,
)
_BINDING = _record("asset_id path", asset_id=NAME, path=NAME, asset_type={"enum": ["screenshot", "image", "chart", "layout"]}, description=TEXT)
_RULE = _record("rule_id kind", rule_id=NAME, kind={"enum": ["required", "regex", "enum", "unique", "reference"]}, severity={"enum": SEVERITIES}, field=TEXT, message=TEXT, options=ANY)
_REGION_TEMPLATE = _record(
    "region_id region_type locator", region_id=NAME, region_type={"enum": REGION_TYPES}, title=TEXT, locator=_LOCATOR, extractor=_EXTRACTOR, screenshot_bindings=_list(_BINDING),
    validation_rules=_list(_RULE), order=_whole(0), required=FLAG,
)
_SHEET_TEMPLATE = _record("sheet_id name_pattern", sheet_id=NAME, name_pattern=PATTERN, regions=_list(_REGION_TEMPLATE), required=FLAG, order=_whole(0))
TEMPLATE = _record(
    "template_id version name sheets schema_version", schema_version={"const": VERSION}, template_id=NAME, version=NAME, name=NAME, description=TEXT, match=_MATCH,
    sheets=_list(_SHEET_TEMPLATE), validation_rules=_list(_RULE), metadata=ANY,
)
