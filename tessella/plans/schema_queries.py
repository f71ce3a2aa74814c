"""Queries that hold documents of JSON against their contracts. Documents are made of the tables' rows, with faults that the
rows' numbers decide; the SQL twins state which faults must be found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import schema as S
from tessella.operators import quality
from tessella.plans import bind
from tessella.plans.oracle import VFILES


def _plans(spark, sf) -> DataFrame:
    """(page_id, text): a plan of one page for each page; twelve kinds of faults and documents without any."""
    n, s = F.col("page_id"), F.col("page_id").cast("string")
    k = n % 13
    page = F.concat(
        F.lit('{"page_id":"p'), s, F.lit('"'),
        F.when(k == 1, "").otherwise(',"title":"T"'),
        F.when(k == 2, F.concat(F.lit(',"output_path":'), s)).otherwise(',"output_path":"a.md"'),
        F.when(k == 3, ',"page_type":"essay"').otherwise(',"page_type":"concept"'),
        F.when(k == 4, ',"purpose":null').otherwise(',"purpose":"x"'),
        F.when(k == 5, ',"source_targets":"d"').when(k == 6, ',"source_targets":["d",{"e":[1]}]').otherwise(',"source_targets":[]'),
        F.lit(',"depends_on":["b"],"status":"planned"'),
        F.when(k == 7, ',"zeta":1,"extra":true').otherwise(""), F.lit("}"),
    )
    text = F.concat(
        F.lit('{"generated_at":"now","sections":[],"generation_order":[],"menu_seed":[{"title":"m","page_ids":'), F.when(k == 8, "[1.5]").otherwise('["x"]'), F.lit("}]"),
        F.when(k == 9, "").when(k == 10, ',"cache_schema_version":1.0').when(k == 11, ',"cache_schema_version":1.5').otherwise(',"cache_schema_version":1'),
        F.lit(',"pages":['), page, F.when(k == 12, "").otherwise("]}"),
    )
    return bind.read(spark, sf, "pages").where("page_id IS NOT NULL").select("page_id", text.alias("text"))


def plan_schema_faults(spark, sf):
    """SC8, U8, H15: page plans held against their contract: missing, surplus and wrong fields, kinds and values. Pages without id are left out."""
    return quality.schema_faults(_plans(spark, sf), S.PAGE_PLAN)


def inventory_schema_faults(spark, sf):
    """SC8, A11: inventories (one a document) held against their contract."""
    n, k = F.col("doc_id"), F.col("doc_id") % 9
    empty = '"languages":[],"frameworks":[],"package_managers":[],"entry_candidates":[],"docs_found":[]'
    entry = F.concat(
        F.lit('{"name":"x","extension":".py","hash":"h"'), F.lit(',"path":'), F.to_json(F.col("path").cast("variant")),
        F.lit(',"size":'), F.when(k == 1, "-1").when(k == 2, '"1"').otherwise(F.col("size").cast("string")),
        F.lit(',"category":'), F.when(k == 3, '"misc"').otherwise('"code"'), F.lit(',"language":'), F.when(k == 4, "7").when(k == 5, "null").otherwise('"python"'),
        F.when(k == 6, "").otherwise(',"is_test":false'), F.lit(',"is_config":'), F.when(k == 7, "0").otherwise("true"), F.lit(',"is_doc":false,"is_generated":false}'),
    )
    stats = ",".join(f'"{x}":2' for x in ("total_files", "code_files", "test_files", "config_files", "doc_files", "generated_files"))
    text = F.concat(
        F.lit(f'{{"cache_schema_version":1,"generated_at":"now","project_name":"p","root_path":"/",{empty},"important_configs":[{{"path":"a","kind":"b"}}],"ignore_rules":{{"default_ignored_dirs":[],"default_ignored_files":[],"gitignore_used":true}},"tree_summary":{{"max_depth":'),
        F.when(k == 8, "-2").otherwise("2"), F.lit(f',"top_level_dirs":[],"top_level_files":[]}},"stats":{{{stats}}},"files":['), entry, F.lit(","), entry, F.lit("]}"),
    )
    docs = bind.vfiles(spark, sf).select(n, text.alias("text"))
    return quality.schema_faults(docs, S.INVENTORY)


def _menu(depth: int) -> str:
    """A menu whose innermost item, so many levels down, has no title and a path that is no text."""
    item = '{"path":1}'
    for _ in range(depth - 1):
        item = f'{{"title":"t","items":[{{"title":"u","path":"a.md"}},{item}]}}'
    return f'{{"cache_schema_version":1,"title":"m","generated_at":"now","items":[{{"title":"g","items":[{item}]}}]}}'


DEPTHS = 6


def menu_schema_faults(spark, sf):
    """Menus, items within items, held against a contract that refers to itself; what is too deep is a fault, too."""
    c = bind.read(spark, sf, "conversations").where("conv_id IS NOT NULL").select("conv_id").distinct()
    text = F.element_at(F.array(*(F.lit(_menu(d + 1)) for d in range(DEPTHS))), (F.col("conv_id") % DEPTHS + 1).cast("int"))
    return quality.schema_faults(c.select("conv_id", text.alias("text")), S.STORED_MENU)


def grouping_schema_faults(spark, sf):
    """H15, SC8: groupings may be lists or maps of lists by title; nothing else."""
    n = F.col("s_suppkey")
    k = n % 6
    group = F.when(k == 0, '["a","b"]').when(k == 1, '{"x":["a"],"y":[]}').when(k == 2, '"a"').when(k == 3, '{"x":["a"],"y":"b"}').when(k == 4, '["a",null]').otherwise("{}")
    text = F.when(k == 5, F.concat(F.lit('{"groupings":{"g'), n.cast("string"), F.lit('":{}},"groupings":{}}'))).otherwise(F.concat(F.lit('{"groupings":{"g'), n.cast("string"), F.lit('":'), group, F.lit(',"h":["z"]}}')))
    return quality.schema_faults(bind.read(spark, sf, "supplier").where("s_suppkey IS NOT NULL").select("s_suppkey", text.alias("text")), S.TOPOLOGY)


QUERIES = {f.__name__: f for f in (plan_schema_faults, inventory_schema_faults, menu_schema_faults, grouping_schema_faults)}

#: Remainder by 13, path, rule, message; @ stands for the page's number.
PLANTED = [
    (1, "pages -> 0", "required", "'title' is required"), (2, "pages -> 0 -> output_path", "type", "@ is not of type string"), (3, "pages -> 0 -> page_type", "enum", '"essay" is not one of "overview", "getting-started", "concept", "deep-dive", "reference", "doc-map", "custom"'),
    (4, "pages -> 0 -> purpose", "type", "null is not of type string"), (5, "pages -> 0 -> source_targets", "type", '"d" is not of type array'), (6, "pages -> 0 -> source_targets -> 1", "type", '{"e":[1]} is not of type string'),
    (7, "pages -> 0", "additionalProperties", "'extra' is not allowed"), (7, "pages -> 0", "additionalProperties", "'zeta' is not allowed"), (8, "menu_seed -> 0 -> page_ids -> 0", "type", "1.5 is not of type string"),
    (9, "(root)", "required", "'cache_schema_version' is required"), (11, "cache_schema_version", "type", "1.5 is not of type integer"), (12, "(root)", "json", "is no JSON"),
]
FILE_FAULTS = [
    (1, "size", "minimum", "-1 is less than 0"), (2, "size", "type", '"1" is not of type integer'), (3, "category", "enum", '"misc" is not one of "code", "test", "config", "doc", "asset", "data", "other"'),
    (4, "language", "type", "7 is not of type string or null"), (6, "", "required", "'is_test' is required"), (7, "is_config", "type", "0 is not of type boolean"),
]


def values(rows: list[tuple]) -> str:
    one = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def _menu_faults(levels: int = 4) -> list[tuple]:
    """What the menu of each depth has: its innermost item's faults, or that it lies too deep."""
    out = []
    for d in range(DEPTHS):
        path = "items -> 0 -> items -> 0" + " -> items -> 1" * d
        if d < levels:
            out += [(d, path, "required", "'title' is required"), (d, f"{path} -> path", "type", "1 is not of type string")]
        else:
            # Both entries of the last list that is looked at lie too deep.
            above = "items -> 0 -> items -> 0" + " -> items -> 1" * (levels - 1)
            out += [(d, f"{above} -> items -> {i}", "depth", f"deeper than {levels} levels of item") for i in (0, 1)]
    return out


ORACLE_SQL = {
    "plan_schema_faults": f"SELECT page_id, path, rule, replace(message, '@', page_id::VARCHAR) AS message FROM pages JOIN (VALUES {values(PLANTED)}) v(k, path, rule, message) ON page_id % 13 = k",
    "inventory_schema_faults": f"""WITH {VFILES} SELECT doc_id, 'files -> ' || i || CASE WHEN field = '' THEN '' ELSE ' -> ' || field END AS path, rule, message
        FROM vfiles JOIN (VALUES {values(FILE_FAULTS)}) v(k, field, rule, message) ON doc_id % 9 = k CROSS JOIN (VALUES (0), (1)) w(i)
        UNION ALL SELECT doc_id, 'tree_summary -> max_depth', 'minimum', '-2 is less than 0' FROM vfiles WHERE doc_id % 9 = 8""",
    "menu_schema_faults": f"SELECT conv_id, path, rule, message FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL) JOIN (VALUES {values(_menu_faults())}) v(k, path, rule, message) ON conv_id % {DEPTHS} = k",
    "grouping_schema_faults": """SELECT s_suppkey, CASE s_suppkey % 6 WHEN 5 THEN '(root)' ELSE 'groupings -> g' || s_suppkey END AS path, CASE s_suppkey % 6 WHEN 5 THEN 'json' ELSE 'anyOf' END AS rule,
          CASE s_suppkey % 6 WHEN 5 THEN 'is no JSON' ELSE 'is of none of 2 forms' END AS message FROM supplier WHERE s_suppkey % 6 IN (2, 3, 4, 5)""",
}
