"""Templates from files and packs."""

import json

import pytest

from gridloom.sources import templates

GOOD = {
    "schema_version": "1.0", "template_id": "t", "version": "2", "name": "n", "match": {"sheet_name_patterns": ["^A$"], "minimum_score": 0.4, "fingerprints": [{"cells": {"B3": "Title"}, "required_text": ["x"], "weight": 1.5}]},
    "sheets": [{"sheet_id": "s", "name_pattern": "^A$", "order": 2, "regions": [{"region_id": "r", "region_type": "table", "order": 5, "locator": {"mode": "fixed", "range": "B2:AA10"}, "extractor": {"kind": "table", "header_rows": 2}}]}],
}


def test_files_and_packs_in_order(tmp_path):
    yaml = pytest.importorskip("yaml")
    (tmp_path / "b.json").write_text(json.dumps(GOOD | {"template_id": "b"}), encoding="utf-8-sig")
    (tmp_path / "A.yaml").write_text(yaml.safe_dump(GOOD | {"template_id": "a"}))
    (tmp_path / "note.txt").write_text("no template")
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "template.yml").write_text(yaml.safe_dump(GOOD | {"template_id": "c"}))
    (tmp_path / "empty").mkdir()
    found = templates.load_templates(str(tmp_path))
    assert [t.template_id for t in found] == ["a", "b", "c"]
    assert templates.load_templates(str(tmp_path / "c")) == [found[2]]
    one = found[0]
    assert one.sheet_patterns == ("^A$",) and one.min_score == 0.4 and one.version == "2"
    assert one.fingerprints[0].cells == {(3, 2): "Title"} and one.fingerprints[0].weight == 1.5
    assert one.regions[0].range == (2, 2, 10, 27) and one.regions[0].header_rows == 2 and one.regions[0].order == 2005


def test_all_problems_are_told_by_place(tmp_path):
    bad = {**GOOD, "version": 2, "sheets": [{"sheet_id": "s", "regions": [{"region_id": "r", "region_type": "table", "locator": {}}]}]}
    found = templates.problems(bad)  # without a mode, what either mode needs is told too
    assert found[0] == "sheets.0: 'name_pattern' is a required property" and found[-1] == "version: 2 is not of type 'string'" and len(found) == 5
    assert "sheets.0.regions.0.locator: 'mode' is a required property" in found
    assert templates.problems([]) == ["$: [] is not of type 'object'"] and templates.problems(GOOD) == []
    with pytest.raises(templates.TemplateError):
        templates.template_of(bad)
    (tmp_path / "x.json").write_text("{")
    for path in ("x.json", "y.toml"):
        with pytest.raises(templates.TemplateError):
            templates.load_template(str(tmp_path / path))


@pytest.mark.parametrize("change", [{"locator": {"mode": "fixed", "range": "A1:Z"}}, {"locator": {"mode": "fixed", "range": "$A$1:B2"}}, {"region_type": "weird"}, {"locator": {"mode": "anchor"}}, {"order": "3"}, {"extractor": {"kind": "table", "header_rows": "x"}}])
def test_wrong_regions_are_told(change):
    """Malformed ranges, unknown types and values of a wrong type are errors with their place, not crashes."""
    sheet = GOOD["sheets"][0]
    bad = {**GOOD, "sheets": [{**sheet, "regions": [{**sheet["regions"][0], **change}]}]}
    with pytest.raises(templates.TemplateError, match=r"sheets\.0\.regions\.0"):
        templates.template_of(bad)


def test_wrong_fingerprints_are_told():
    for match in ({"fingerprints": [{"cells": {"$A$1": "x"}}]}, {"fingerprints": [{"cells": {"A1": "x"}, "weight": "2"}]}, {"minimum_score": 2}):
        with pytest.raises(templates.TemplateError, match="match"):
            templates.template_of({**GOOD, "match": match})


def test_a_loaded_template_scores_cells(spark):
    from gridloom.operators.template import score

    cells = spark.createDataFrame([("d", "A", 3, 2, "Title"), ("d", "A", 4, 2, "x")], "doc string, sheet string, row int, col int, display string")
    assert score(cells, templates.template_of(GOOD)).count() == 1
