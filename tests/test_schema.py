"""Documents of JSON against schemas; the contracts accept the least document that a user of them writes."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.functions import schema as S
from tessella.operators import quality
from tessella.sources import sinks

ENTRY = {"path": "src/app.py", "name": "app.py", "extension": ".py", "size": 12, "hash": "abc123", "category": "code", "language": "python", "is_test": False, "is_config": False, "is_doc": False, "is_generated": False}
INVENTORY = {
    "cache_schema_version": 1, "generated_at": "2026-05-08T00:00:00+00:00", "project_name": "sample", "root_path": "/tmp/sample", "languages": ["python"], "frameworks": [], "package_managers": ["pip"],
    "entry_candidates": [{"path": "src/app.py", "reason": "main-like filename"}], "important_configs": [{"path": "pyproject.toml", "kind": "python"}], "docs_found": ["README.md"],
    "ignore_rules": {"default_ignored_dirs": ["node_modules"], "default_ignored_files": [], "gitignore_used": False}, "tree_summary": {"max_depth": 2, "top_level_dirs": ["src"], "top_level_files": ["README.md"]},
    "stats": {"total_files": 2, "code_files": 1, "test_files": 0, "config_files": 1, "doc_files": 1, "generated_files": 0}, "files": [ENTRY],
}
ANALYSIS = {
    "cache_schema_version": 1, "generated_at": "now", "project_purpose": "x", "architecture_model": {"summary": "s", "details": {"style": "agentic"}}, "runtime_flows": [{"name": "n", "summary": "s", "evidence": [{"path": "SKILL.md", "reason": "r"}]}],
    "concepts": [{"name": "n", "summary": "s"}], "modules": [{"name": "CLI", "summary": "s", "source_targets": ["scripts/cli.py"]}], "cross_cutting_concerns": [], "risks": [], "extension_points": [], "source_evidence": [{"path": "SKILL.md", "reason": "r"}], "confidence": "high", "open_questions": [],
}
PLAN = {"cache_schema_version": 1, "generated_at": "now", "sections": [{"id": "overview", "title": "Overview", "page_ids": ["overview"]}], "pages": [{"page_id": "overview", "title": "Overview", "output_path": "overview.md", "page_type": "overview", "purpose": "p", "source_targets": ["README.md"], "depends_on": [], "status": "planned"}], "generation_order": ["overview"], "menu_seed": [{"title": "Overview", "page_ids": ["overview"]}]}
CONTEXT = {"page_id": "overview", "objective": "o", "source_files": [{"path": "README.md", "reason": "r"}], "source_excerpts": [{"path": "README.md", "start_line": 1, "end_line": 3, "text": "# Sample\n\nIntro"}], "related_pages": [], "claims_to_cover": ["p"], "must_link_symbols": [], "constraints": ["c"]}
MENU = {"cache_schema_version": 2, "title": "p", "version": None, "generated_at": "now", "items": [{"title": "g", "items": [{"title": "a", "path": "a.md", "planned": True, "items": [{"title": "b"}]}]}]}


@pytest.fixture
def found(spark):
    """The faults of values under a schema, one list a value; text is taken as it is."""

    def check(schema, *values, levels=4):
        rows = [(n, v if isinstance(v, str) else json.dumps(v)) for n, v in enumerate(values)]
        out = [[] for _ in values]
        for r in quality.schema_faults(spark.createDataFrame(rows, "n int, text string"), schema, levels=levels).collect():
            out[r.n].append((r.path, r.rule, r.message))
        return [sorted(x) for x in out]

    return check


def test_contracts_accept_least_documents(found):
    for schema, doc in ((S.INVENTORY, INVENTORY), (S.ANALYSIS, ANALYSIS), (S.PAGE_PLAN, PLAN), (S.PAGE_CONTEXT, CONTEXT), (S.STORED_MENU, MENU)):
        less = {k: v for k, v in doc.items() if k != "generated_at"} if "generated_at" in doc else {k: v for k, v in doc.items() if k != "page_id"}
        gone = "generated_at" if "generated_at" in doc else "page_id"
        assert found(schema, doc, less) == [[], [("(root)", "required", f"'{gone}' is required")]]


def test_kinds(found):
    values = [1, 1.0, 1.5, -0.0, 1e30, "1", "", True, None, [], [1], {}, {"a": 1}]
    want = {
        "integer": {0, 1, 3, 4}, "number": {0, 1, 2, 3, 4}, "string": {5, 6}, "boolean": {7}, "null": {8}, "array": {9, 10}, "object": {11, 12},
    }
    texts = [json.dumps(v) for v in values]
    for kind, good in want.items():
        assert {n for n, f in enumerate(found({"type": kind}, *texts)) if not f} == good, kind
    assert {n for n, f in enumerate(found({"type": ["string", "null"]}, *texts)) if not f} == {5, 6, 8}
    assert found({"type": "string"}, "3", "[1]") == [[("(root)", "type", "3 is not of type string")], [("(root)", "type", "[1] is not of type string")]]


def test_keywords(found):
    assert found({"minimum": 2, "maximum": 4}, "1", "2", "4.5", '"x"', "[]") == [[("(root)", "minimum", "1 is less than 2")], [], [("(root)", "maximum", "4.5 is more than 4")], [], []]
    assert [len(f) for f in found({"minLength": 2, "maxLength": 3, "pattern": "^[ab]"}, '"a"', '"abc"', '"zzzz"', "5")] == [1, 0, 2, 0]
    assert [len(f) for f in found({"minItems": 1, "maxItems": 2, "uniqueItems": True}, [], [1], [1, 1], [1, 2, 3], [{"a": 1}, {"a": 1}], {})] == [1, 0, 1, 1, 1, 0]
    assert [len(f) for f in found({"enum": ["a", 1, None, [1]]}, '"a"', "1", "null", "[1]", '"1"', "2")] == [0, 0, 0, 0, 1, 1]
    assert [len(f) for f in found({"const": "x"}, '"x"', '"y"')] == [0, 1]
    more = {"properties": {"a": {"type": "string"}}, "additionalProperties": {"type": "integer"}}
    assert found(more, {"a": "x", "b": 1}, {"a": 1, "b": "x", "c d": None}) == [[], [("a", "type", "1 is not of type string"), ("b", "type", '"x" is not of type integer'), ("c d", "type", "null is not of type integer")]]
    closed = {"required": ["a", "z"], "properties": {"a": {}}, "additionalProperties": False}
    assert found(closed, {"a": None, "z": 1}, {"y": 1, "b": 2}) == [[("(root)", "additionalProperties", "'z' is not allowed")], [("(root)", "additionalProperties", "'b' is not allowed"), ("(root)", "additionalProperties", "'y' is not allowed"), ("(root)", "required", "'a' is required"), ("(root)", "required", "'z' is required")]]


def test_lists_or_maps(found):
    good, bad = {"groupings": {"a": ["x"], "b": {"c": ["y"], "d": []}}}, {"groupings": {"a": "x", "b": {"c": "y"}, "e": [1]}}
    assert found(S.TOPOLOGY, good, bad) == [[], [(f"groupings -> {k}", "anyOf", "is of none of 2 forms") for k in "abe"]]


def test_definitions_within_themselves(found):
    tree = {"$ref": "#/definitions/t", "definitions": {"t": {"required": ["v"], "properties": {"v": {"type": "integer"}, "of": {"type": "array", "items": {"$ref": "#/definitions/t"}}}}}}
    doc = {"v": 1, "of": [{"v": 2}, {"v": 3, "of": [{"v": "x"}, {"v": 5, "of": [{"v": 6}]}]}]}
    assert found(tree, doc, levels=4) == [[("of -> 1 -> of -> 0 -> v", "type", '"x" is not of type integer')]]
    assert found(tree, doc, levels=3)[0][1:] == [("of -> 1 -> of -> 1 -> of -> 0", "depth", "deeper than 3 levels of t")]
    with pytest.raises(ValueError, match="no definition"):
        S.faults(F.lit(None), {"$ref": "#/definitions/nope"})


def test_documents_that_are_none(spark, found):
    assert found({"type": "object"}, "{", "", '{"a":1,"a":2}') == [[("(root)", "json", "is no JSON")]] * 3
    df = spark.createDataFrame([(None,)], "text string")
    assert [tuple(r) for r in quality.schema_faults(df, {}).collect()] == [("(root)", "json", "is no JSON")]
    assert quality.schema_faults(df.limit(0), S.PAGE_PLAN).count() == 0
    assert found({"type": "array", "items": {"type": "integer"}}, [0] * 20_000 + ["x"]) == [[("20000", "type", '"x" is not of type integer')]]


def test_unknown_keywords_are_refused():
    with pytest.raises(ValueError, match="multipleOf"):
        S.faults(F.lit(None), {"multipleOf": 2})


def test_a_schema_is_a_plan_without_python(spark):
    df = quality.schema_faults(spark.createDataFrame([("{}",)], "text string"), S.INVENTORY)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_menus_that_break_the_contract_are_not_written(spark, tmp_path):
    rows = spark.createDataFrame([(0, "S", 0, "T", "a.md"), (0, "S", 1, None, "b.md")], "section_pos int, section string, pos int, title string, path string")
    sinks.menu(rows.where("pos = 0"), str(tmp_path / "good"), "P")
    assert (tmp_path / "good").exists()
    with pytest.raises(ValueError, match="'title' is required"):
        sinks.menu(rows, str(tmp_path / "bad"), "P")
    assert not (tmp_path / "bad").exists()
