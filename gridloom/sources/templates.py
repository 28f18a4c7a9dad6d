"""Templates from YAML and JSON files and packs. The driver reads them: a few small files at any size of the data."""

from __future__ import annotations

import json
import os
import re

from gridloom.functions.json_schema import violations
from gridloom.operators.document_rules import RegionRules, Rule, RuleSet, SheetRules
from gridloom.operators.regions import Sheet
from gridloom.operators.template import Fingerprint, Region, Template
from gridloom.sources.document_schema import TEMPLATE

SUFFIXES = (".json", ".yaml", ".yml")
class TemplateError(ValueError):
    """All that is wrong with a template, one line each, ordered by where it is."""


def _position(address: str) -> tuple[int, int]:
    letters, row = re.fullmatch(r"([A-Za-z]{1,3})([1-9]\d*)", address).groups()
    col = 0
    for c in letters.upper():
        col = 26 * col + ord(c) - 64
    return int(row), col


def problems(data: object) -> list[str]:
    """`path: message` of all that breaks the template schema, ordered by path; $ is the root."""
    found = sorted(violations(TEMPLATE, data), key=lambda x: x[0])
    return [f"{'.'.join(at) or '$'}: {message}" for at, _, message in found]


def _flag(value: object) -> bool:
    return value.strip().lower() in ("1", "true", "yes", "on") if isinstance(value, str) else bool(value)


def _pairs(mapping: dict | None) -> tuple[tuple[str, str], ...]:
    return tuple((str(k), str(v)) for k, v in (mapping or {}).items())


def _region(raw: dict, sheet_order: int) -> Region:
    """Without an extractor a region is extracted by its type; blanks and columns are cut as its options say."""
    place, extractor = raw["locator"], raw.get("extractor") or {}
    options = extractor.get("options") or {}
    box = None
    if place.get("range"):
        first, _, last = place["range"].partition(":")
        box = (*_position(first), *_position(last or first))
    return Region(
        region_id=raw["region_id"], kind=extractor.get("kind") or raw["region_type"], order=1_000 * sheet_order + int(raw.get("order") or 0), title=raw.get("title"), required=bool(raw.get("required")), range=box,
        anchor_text=place.get("anchor_text"), anchor_pattern=place.get("anchor_pattern"), end_text=place.get("end_anchor_text"), end_pattern=place.get("end_anchor_pattern"),
        row_offset=int(place.get("row_offset") or 0), col_offset=int(place.get("column_offset") or 0), height=place.get("height"), width=place.get("width"), repeat=bool(place.get("repeat_anchor")),
        header_rows=int(extractor.get("header_rows") or 0), key_col=int(extractor.get("key_column") or 1), value_col=int(extractor.get("value_column") or 2), keys=_pairs(extractor.get("key_semantics")), columns=_pairs(extractor.get("column_semantics")),
        stop_after=int(options.get("stop_after_blank_rows") or 0), shrink=_flag(options.get("shrink_to_content")), trim=_flag(options["trim_empty_columns"]) if "trim_empty_columns" in options else None,
        ignore=raw["region_type"] == "ignore" or _flag(options.get("ignore")),
    )


def template_of(data: dict) -> Template:
    """The template that a mapping describes; TemplateError with all problems() if it has any."""
    if wrong := problems(data):
        raise TemplateError("; ".join(wrong))
    match = data.get("match") or {}
    marks = [Fingerprint({_position(a): str(t) for a, t in (f.get("cells") or {}).items()}, tuple(f.get("required_text") or ()), float(f.get("weight", 1.0)), f.get("sheet_name_pattern")) for f in match.get("fingerprints") or []]
    regions = [r for s in sheets_of(data) for r in s.regions]
    score = {"min_score": float(match["minimum_score"])} if "minimum_score" in match else {}
    return Template(data["template_id"], data["version"], tuple(match.get("sheet_name_patterns") or ()), tuple(marks), tuple(regions), **score)


def sheets_of(data: dict) -> tuple[Sheet, ...]:
    """The sheets of a mapping without problems(), for gridloom.operators.regions."""
    return tuple(Sheet(s["sheet_id"], s["name_pattern"], tuple(_region(r, int(s.get("order") or 0)) for r in s.get("regions") or []), bool(s.get("required", True))) for s in data["sheets"])


def rules_of(data: dict) -> RuleSet:
    """The rules of a mapping without problems(): those of its regions, and its own."""
    rule = lambda r: Rule(r["rule_id"], r["kind"], r.get("field") or "", r.get("severity", "error"), r.get("message"), dict(r.get("options") or {}))
    regions = lambda s: tuple(RegionRules(g["region_id"], bool(g.get("required")), tuple(map(rule, g.get("validation_rules") or []))) for g in s.get("regions") or [])
    sheets = tuple(SheetRules(s["sheet_id"], s["name_pattern"], bool(s.get("required", True)), regions(s)) for s in data["sheets"])
    return RuleSet(sheets, tuple(map(rule, data.get("validation_rules") or [])))


def _pack_file(folder: str) -> str | None:
    return next((p for s in (".yaml", ".yml", ".json") if os.path.isfile(p := os.path.join(folder, f"template{s}"))), None)


def load_template(path: str) -> Template:
    """The template of a file (a byte-order mark is skipped), or of a pack: a folder with template.yaml, .yml or .json."""
    file = _pack_file(path) if os.path.isdir(path) else path
    suffix = os.path.splitext(file or path)[1].lower()
    if file is None or suffix not in SUFFIXES:
        raise TemplateError(f"no template file: {path}")
    with open(file, encoding="utf-8-sig") as f:
        text = f.read()
    try:
        if suffix == ".json":
            data = json.loads(text)
        else:
            import yaml

            data = yaml.safe_load(text)
    except Exception as error:  # the two parsers have no common class of errors
        raise TemplateError(f"cannot read {file}: {error}") from error
    return template_of(data)


def load_templates(folder: str) -> list[Template]:
    """All templates and packs of a folder, or the one of a pack, by name without regard to case."""
    if _pack_file(folder):
        return [load_template(folder)]
    paths = [os.path.join(folder, n) for n in sorted(os.listdir(folder), key=lambda n: (n.casefold(), n))]
    return [load_template(p) for p in paths if (_pack_file(p) if os.path.isdir(p) else os.path.splitext(p)[1].lower() in SUFFIXES)]
