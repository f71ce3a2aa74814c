"""JSON Schema as column expressions: a schema is compiled to one expression over a VARIANT, which gives the faults of a document.

    df.select(F.inline(faults(F.try_parse_json("text"), PAGE_PLAN)))

A fault is (path within the document, rule, message). Every fault is given, not the first alone. Keywords: type,
required, properties, additionalProperties, items, enum, const, minimum, maximum, minLength, maxLength, pattern,
minItems, maxItems, uniqueItems, anyOf, $ref to the schema's own definitions; notes (title, description, default,
format and the like) say nothing about validity, any other keyword is refused. An expression has an end, so a
definition that refers to itself is followed for a number of levels; a value below those is a fault of its own.

A document that is null or no JSON has one fault. Of a name that an object has twice the parser makes no document.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FAULTS = "array<struct<path:string,rule:string,message:string>>"
NOTES = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "format", "definitions"}
ROOT = "(root)"


def _none() -> Column:
    return F.array().cast(FAULTS)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _fault(path: Column | None, rule: str, message: Column) -> Column:
    return F.struct((F.lit(ROOT) if path is None else path).alias("path"), F.lit(rule).alias("rule"), message.alias("message"))


def _below(path: Column | None, step: Column) -> Column:
    return step if path is None else F.concat(path, F.lit(" -> "), step)


def _said(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _plain(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


class _Compiler:
    def __init__(self, schema: dict, levels: int):
        self.definitions, self.levels = schema.get("definitions", {}), levels

    def faults(self, value: Column, schema: dict, path: Column | None, seen: tuple[str, ...]) -> Column:
        """value is a variant that isn't SQL's null."""
        if "$ref" in schema:
            name = schema["$ref"].removeprefix("#/definitions/")
            if name not in self.definitions:
                raise ValueError(f"no definition {schema['$ref']}")
            if seen.count(name) >= self.levels:
                return F.array(_fault(path, "depth", F.lit(f"deeper than {self.levels} levels of {name}"))).cast(FAULTS)
            return self.faults(value, self.definitions[name], path, (*seen, name))
        unknown = set(schema) - NOTES - set(CHECKS) - {"type", "required", "properties", "additionalProperties", "items", "anyOf", "minItems", "maxItems", "uniqueItems"}
        if unknown:
            raise ValueError(f"keywords that aren't known: {sorted(unknown)}")
        fields = F.try_variant_get(value, "$", "map<string,variant>")
        entries = F.try_variant_get(value, "$", "array<variant>")
        return _let(fields, lambda f: _let(entries, lambda e: self.checked(value, f, e, schema, path, seen)))

    def checked(self, value: Column, fields: Column, entries: Column, schema: dict, path: Column | None, seen: tuple[str, ...]) -> Column:
        found = []
        kind = F.when(fields.isNotNull(), F.lit("object")).when(entries.isNotNull(), F.lit("array")).when(F.is_variant_null(value), F.lit("null")).otherwise(F.schema_of_variant(value))
        if "type" in schema:
            types = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
            number = F.try_variant_get(value, "$", "double")
            numeric = lambda k: k.isin("BIGINT", "DOUBLE", "FLOAT") | k.startswith("DECIMAL")
            holds = {
                "object": lambda k: k == "object", "array": lambda k: k == "array", "null": lambda k: k == "null", "string": lambda k: k == "STRING",
                "boolean": lambda k: k == "BOOLEAN", "number": numeric, "integer": lambda k: numeric(k) & (number == F.rint(number)),
            }
            any_of = lambda k: F.exists(F.array(*(F.coalesce(holds[t](k), F.lit(False)) for t in types)), lambda x: x)
            message = _said(F.to_json(value), f" is not of type {' or '.join(types)}")
            found.append(_let(kind, lambda k: F.when(any_of(k), _none()).otherwise(F.array(_fault(path, "type", message)))))
        for word, check in CHECKS.items():
            if word in schema:
                wrong, message = check(value, kind, schema[word])
                found.append(F.when(F.coalesce(wrong, F.lit(False)), F.array(_fault(path, word, message))).otherwise(_none()))
        found += self.of_object(fields, schema, path, seen)
        found += self.of_array(entries, schema, path, seen)
        if "anyOf" in schema:
            forms = [self.faults(value, s, path, seen) for s in schema["anyOf"]]
            fits = F.exists(F.array(*(F.size(f) for f in forms)), lambda n: n == 0)
            found.append(F.when(fits, _none()).otherwise(F.array(_fault(path, "anyOf", F.lit(f"is of none of {len(forms)} forms")))))
        return F.concat(*found, _none())

    def of_object(self, fields: Column, schema: dict, path: Column | None, seen: tuple[str, ...]) -> list[Column]:
        found, own = [], schema.get("properties", {})
        if schema.get("required"):
            names = F.array(*map(F.lit, schema["required"]))
            missing = F.transform(F.filter(names, lambda n: ~F.map_contains_key(fields, n)), lambda n: _fault(path, "required", _said("'", n, "' is required")))
            found.append(missing)
        found += [_let(F.try_element_at(fields, F.lit(name)), self.if_there(sub, _below(path, F.lit(name)), seen)) for name, sub in own.items()]
        more = schema.get("additionalProperties", True)
        if more is not True:
            others = F.sort_array(F.array_except(F.map_keys(fields), F.array(*map(F.lit, own)) if own else F.array().cast("array<string>")))
            if more is False:
                found.append(F.transform(others, lambda n: _fault(path, "additionalProperties", _said("'", n, "' is not allowed"))))
            else:
                found.append(F.flatten(F.transform(others, lambda n: self.faults(F.element_at(fields, n), more, _below(path, n), seen))))
        return [F.when(fields.isNotNull(), F.concat(*(f.cast(FAULTS) for f in found))).otherwise(_none())] if found else []

    def if_there(self, schema: dict, path: Column, seen: tuple[str, ...]) -> Callable[[Column], Column]:
        return lambda v: F.when(v.isNotNull(), self.faults(v, schema, path, seen)).otherwise(_none())

    def of_array(self, entries: Column, schema: dict, path: Column | None, seen: tuple[str, ...]) -> list[Column]:
        found = []
        if "items" in schema:
            found.append(F.flatten(F.transform(entries, lambda v, i: self.faults(v, schema["items"], _below(path, i.cast("string")), seen))))
        n = F.size(entries)
        counts = {"minItems": lambda least: (n < least, f"has fewer than {least} entries"), "maxItems": lambda most: (n > most, f"has more than {most} entries"), "uniqueItems": lambda on: (F.lit(on) & (F.size(F.array_distinct(F.transform(entries, lambda v: F.to_json(v)))) < n), "has entries twice")}
        for word, check in counts.items():
            if word in schema:
                wrong, message = check(schema[word])
                found.append(F.when(wrong, F.array(_fault(path, word, F.lit(message)))).otherwise(_none()))
        return [F.when(entries.isNotNull(), F.concat(*(f.cast(FAULTS) for f in found))).otherwise(_none())] if found else []


def _number(compare: Callable[[Column, float], Column], word: str):
    def check(value: Column, kind: Column, bound: float) -> tuple[Column, Column]:
        numeric = ~kind.isin("object", "array", "null", "STRING", "BOOLEAN")
        return numeric & compare(F.try_variant_get(value, "$", "double"), bound), _said(F.to_json(value), f" is {word} than {_plain(bound)}")

    return check


def _text(compare: Callable[[Column, object], Column], message: Callable[[object], str]):
    def check(value: Column, kind: Column, bound) -> tuple[Column, Column]:
        return (kind == "STRING") & compare(F.try_variant_get(value, "$", "string"), bound), _said(F.to_json(value), f" {message(bound)}")

    return check


def _one_of(value: Column, kind: Column, allowed: list) -> tuple[Column, Column]:
    return ~F.to_json(value).isin(*map(_plain, allowed)), _said(F.to_json(value), f" is not one of {', '.join(map(_plain, allowed))}")


#: Keywords about single values: (value, kind, keyword's value) to (whether it is wrong, message).
CHECKS = {
    "enum": _one_of,
    "const": lambda value, kind, only: _one_of(value, kind, [only]),
    "minimum": _number(lambda x, least: x < least, "less"),
    "maximum": _number(lambda x, most: x > most, "more"),
    "minLength": _text(lambda x, n: F.length(x) < n, lambda n: f"is shorter than {n}"),
    "maxLength": _text(lambda x, n: F.length(x) > n, lambda n: f"is longer than {n}"),
    "pattern": _text(lambda x, p: ~x.rlike(p), lambda p: f"does not match {p}"),
}


def faults(document: Column, schema: dict, levels: int = 4) -> Column:
    """The faults (FAULTS) of a variant; levels: how often a definition may be entered within itself."""
    compiled = _let(document, lambda v: _Compiler(schema, levels).faults(v, schema, None, ()))
    return F.when(document.isNull(), F.array(_fault(None, "json", F.lit("is no JSON"))).cast(FAULTS)).otherwise(compiled)


# Contracts. The names and kinds of their fields.

TEXT, WHOLE, COUNT, FLAG = {"type": "string"}, {"type": "integer"}, {"type": "integer", "minimum": 0}, {"type": "boolean"}
PLACE = {"type": "integer", "minimum": 1}


def listed(of: dict) -> dict:
    return {"type": "array", "items": of}


def one_of(*values: str) -> dict:
    return {"type": "string", "enum": list(values)}


def record(optional: dict | None = None, **fields: dict) -> dict:
    """An object of these fields and no others."""
    return {"type": "object", "required": list(fields), "properties": fields | (optional or {}), "additionalProperties": False}


TEXTS = listed(TEXT)
PAGE_TYPES = ("overview", "getting-started", "concept", "deep-dive", "reference", "doc-map", "custom")
STATUSES = ("planned", "in_progress", "completed", "failed", "skipped")
PAGE_PLAN = record(
    cache_schema_version=WHOLE,
    generated_at=TEXT,
    sections=listed(record(id=TEXT, title=TEXT, page_ids=TEXTS)),
    pages=listed(record(page_id=TEXT, title=TEXT, output_path=TEXT, page_type=one_of(*PAGE_TYPES), purpose=TEXT, source_targets=TEXTS, depends_on=TEXTS, status=one_of(*STATUSES))),
    generation_order=TEXTS,
    menu_seed=listed(record(title=TEXT, page_ids=TEXTS)),
)
CATEGORIES = ("code", "test", "config", "doc", "asset", "data", "other")
INVENTORY = record(
    cache_schema_version=WHOLE,
    generated_at=TEXT,
    project_name=TEXT,
    root_path=TEXT,
    languages=TEXTS,
    frameworks=TEXTS,
    package_managers=TEXTS,
    entry_candidates=listed(record(path=TEXT, reason=TEXT)),
    important_configs=listed(record(path=TEXT, kind=TEXT)),
    docs_found=TEXTS,
    ignore_rules=record(default_ignored_dirs=TEXTS, default_ignored_files=TEXTS, gitignore_used=FLAG),
    tree_summary=record(max_depth=COUNT, top_level_dirs=TEXTS, top_level_files=TEXTS),
    stats=record(**dict.fromkeys(["total_files", "code_files", "test_files", "config_files", "doc_files", "generated_files"], COUNT)),
    files=listed(
        record(
            path=TEXT,
            name=TEXT,
            extension=TEXT,
            size=COUNT,
            hash=TEXT,
            category=one_of(*CATEGORIES),
            language={"type": ["string", "null"]},
            is_test=FLAG,
            is_config=FLAG,
            is_doc=FLAG,
            is_generated=FLAG,
        )
    ),
)
EVIDENCE = listed(record({"line": PLACE, "end_line": PLACE}, path=TEXT, reason=TEXT))
NAMED = listed(record({"evidence": EVIDENCE}, name=TEXT, summary=TEXT))
ANALYSIS = record(
    cache_schema_version=WHOLE,
    generated_at=TEXT,
    project_purpose=TEXT,
    architecture_model=record({"details": {"type": "object"}}, summary=TEXT),
    runtime_flows=NAMED,
    concepts=NAMED,
    modules=listed(record({"evidence": EVIDENCE}, name=TEXT, summary=TEXT, source_targets=TEXTS)),
    cross_cutting_concerns=NAMED,
    risks=NAMED,
    extension_points=NAMED,
    source_evidence=EVIDENCE,
    confidence=one_of("high", "medium", "low"),
    open_questions=TEXTS,
)
PAGE_CONTEXT = record(
    page_id=TEXT,
    objective=TEXT,
    source_files=listed(record(path=TEXT, reason=TEXT)),
    source_excerpts=listed(record(path=TEXT, start_line=PLACE, end_line=PLACE, text=TEXT)),
    related_pages=TEXTS,
    claims_to_cover=TEXTS,
    must_link_symbols=TEXTS,
    constraints=TEXTS,
)
MENU = {
    "type": "object",
    "required": ["title", "items"],
    "properties": {"cache_schema_version": WHOLE, "title": TEXT, "version": {"type": ["string", "null"]}, "generated_at": TEXT, "reconciled": FLAG, "reconciled_at": {"type": ["string", "null"]}, "items": listed({"$ref": "#/definitions/group"})},
    "definitions": {
        "group": {"type": "object", "required": ["title", "items"], "properties": {"title": TEXT, "items": listed({"$ref": "#/definitions/item"})}},
        "item": {"type": "object", "required": ["title"], "properties": {"title": TEXT, "path": TEXT, "planned": FLAG, "items": listed({"$ref": "#/definitions/item"})}},
    },
}
#: As stored, with the envelope that stored menus have.
STORED_MENU = MENU | {"required": ["cache_schema_version", "title", "generated_at", "items"]}
#: Groupings of pages by title are lists, or maps of lists by subtitle.
TOPOLOGY = {"type": "object", "required": ["groupings"], "properties": {"groupings": {"type": "object", "additionalProperties": {"anyOf": [TEXTS, {"type": "object", "additionalProperties": TEXTS}]}}}}
CONTRACTS = {"page-plan": PAGE_PLAN, "inventory": INVENTORY, "semantic-analysis": ANALYSIS, "page-context": PAGE_CONTEXT, "menu": STORED_MENU, "topology": TOPOLOGY}
