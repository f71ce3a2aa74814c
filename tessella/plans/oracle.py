"""SQL twins of the registered queries, for an independent engine over the same tables."""

from __future__ import annotations

from tessella.functions import rules as R
from tessella.plans.bind import DIRS, NAMES, SUFFIXES


def q(values) -> str:
    """A list of SQL strings."""
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def any_of(text: str, marks) -> str:
    return "(" + " OR ".join(f"contains({text}, '{m}')" for m in marks) + ")"


VFILES = f"""
vraw AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(n_chars, 0) AS size,
         coalesce(source, 'none') || '/' || coalesce(lang, 'und') AS module,
         list_extract([{q(DIRS)}], CAST((doc_id // 3) % {len(DIRS)} AS INT) + 1) AS dir,
         list_extract([{q(NAMES)}], CAST((doc_id // 5) % {len(NAMES)} AS INT) + 1) AS stem,
         list_extract([{q(SUFFIXES)}], CAST(doc_id % {len(SUFFIXES)} AS INT) + 1) AS extension
  FROM documents WHERE doc_id IS NOT NULL),
vfiles AS (
  SELECT *, module || '/' || dir || '/d' || doc_id || '/' || stem || extension AS path, stem || extension AS name,
         len(string_split(dir, '/')) + 4 AS depth
  FROM vraw)"""

CATEGORY = f"""CASE WHEN {any_of("'/' || path", R.TEST_MARKS)} THEN 'test' WHEN name IN ({q(R.CONFIG_KIND)}) THEN 'config'
  WHEN extension IN ({q(R.DOC_SUFFIXES)}) THEN 'doc' WHEN extension IN ({q(R.LANGUAGE_OF)}) THEN 'code'
  WHEN extension IN ({q(R.DATA_SUFFIXES)}) THEN 'data' ELSE 'other' END"""
LANGUAGE = "CASE extension " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.LANGUAGE_OF.items()) + " END"
INV = f"""{VFILES},
inv AS (
  SELECT doc_id, module, path, name, extension, size, substr(sha256(text), 1, 16) AS hash, {CATEGORY} AS category, {LANGUAGE} AS language,
         {any_of("'/' || path", R.GENERATED_MARKS)} AS is_generated, depth
  FROM vfiles)"""
PURPOSE = "CASE " + " ".join(f"WHEN {any_of('lower(path)', m)} THEN '{n}'" for n, m in R.PURPOSES) + " ELSE 'Other' END"

SCORED = f"""{VFILES},
scored AS (
  SELECT *,
    CASE WHEN dir = 'src' OR dir = 'lib/core' THEN 1.0::DOUBLE WHEN dir = 'cmd' THEN 0.8::DOUBLE WHEN {any_of("lower(path)", ["database", "schema", "migration"])} THEN 0.6::DOUBLE ELSE 0.2::DOUBLE END AS path_score,
    CASE WHEN lower(stem) IN ('main', 'index', 'app', 'mod') THEN 1.0::DOUBLE WHEN {any_of("lower(stem)", R.BUSINESS_WORDS)} THEN 0.8::DOUBLE
         WHEN len(list_intersect(string_split(lower(path), '/'), [{q(R.BUSINESS_WORDS)}])) > 0 THEN 0.5::DOUBLE
         WHEN {any_of("lower(path)", ["config", "setup", "setting"])} THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS identity_score,
    CASE WHEN extension IN ('.py', '.ts', '.go', '.rs') THEN 1.0::DOUBLE WHEN extension = '.sql' THEN 0.9::DOUBLE WHEN name IN ({q(R.BUILD_NAMES)}) THEN 0.5::DOUBLE
         WHEN extension IN ('.json', '.yaml') THEN 0.4::DOUBLE WHEN extension = '.lock' THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS lang_score,
    CASE WHEN size BETWEEN 1024 AND 51200 THEN 1.0::DOUBLE WHEN size BETWEEN 100 AND 1023 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS size_score,
    0.0::DOUBLE AS degree_score
  FROM vfiles),
totalled AS (
  SELECT *, round(least(path_score * 0.3::DOUBLE + identity_score * 0.25::DOUBLE + lang_score * 0.3::DOUBLE + size_score * 0.15::DOUBLE + degree_score * 0.15::DOUBLE, 1.0::DOUBLE), 4) AS total FROM scored),
raw_ranked AS (SELECT *, CAST(printf('%.2f', total) AS DOUBLE) AS importance_score, total >= 0.5 AS is_core, total >= 0.6 AS is_high_priority FROM totalled)"""
NORMAL = f"""{SCORED},
shared AS (
  SELECT *, count(*) OVER (PARTITION BY module) AS members,
         (rank() OVER (PARTITION BY module ORDER BY path_score) - 1)::DOUBLE / count(*) OVER (PARTITION BY module) AS share
  FROM totalled),
normal AS (
  SELECT *, CASE WHEN members >= 2 THEN share END AS percentile,
         CASE WHEN members < 2 THEN path_score WHEN share >= 0.9 THEN 1.0::DOUBLE WHEN share >= 0.7 THEN 0.8::DOUBLE WHEN share >= 0.5 THEN 0.6::DOUBLE WHEN share >= 0.3 THEN 0.4::DOUBLE ELSE 0.2::DOUBLE END AS path_score_normalized
  FROM shared),
ranked AS (
  SELECT *, CAST(printf('%.2f', least(path_score_normalized * 0.3::DOUBLE + identity_score * 0.25::DOUBLE + lang_score * 0.3::DOUBLE + size_score * 0.15::DOUBLE + degree_score * 0.15::DOUBLE, 1.0::DOUBLE)) AS DOUBLE) AS importance_score
  FROM normal),
cuts AS (
  SELECT CASE WHEN n < 20 THEN 0.5::DOUBLE ELSE greatest(0.2::DOUBLE, least(0.9::DOUBLE, s[CAST(floor(n * 0.35::DOUBLE) AS INT) + 1])) END AS core,
         CASE WHEN n < 20 THEN 0.6::DOUBLE ELSE greatest(0.2::DOUBLE, least(0.9::DOUBLE, s[CAST(floor(n * 0.15::DOUBLE) AS INT) + 1])) END AS high
  FROM (SELECT count(*) AS n, list(importance_score ORDER BY importance_score DESC) AS s FROM ranked)),
flagged AS (SELECT ranked.*, importance_score >= core AS is_core, importance_score >= high AS is_high_priority FROM ranked, cuts)"""
SNAPSHOTS = f"""{VFILES},
hashed AS (SELECT *, substr(sha256(text), 1, 16) AS h FROM vfiles),
old_snap AS (SELECT path, CASE WHEN doc_id % 5 = 0 THEN 'x' || substr(h, 2, 15) ELSE h END AS hash FROM hashed WHERE doc_id % 7 <> 0),
new_snap AS (SELECT path, h AS hash FROM hashed WHERE doc_id % 11 <> 0),
diffed AS (
  SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN o.hash = n.hash THEN 'unchanged' ELSE 'modified' END AS status
  FROM old_snap o FULL JOIN new_snap n ON o.path = n.path)"""
EDGES = """
edges AS (
  SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem
  UNION SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey FROM lineitem WHERE l_linenumber = 1),
members AS (SELECT 'p' || p_partkey AS file, p_brand AS module FROM part UNION ALL SELECT 's' || s_suppkey, 'nation' || s_nationkey FROM supplier),
medges AS (
  SELECT e.src, e.dst, a.module AS src_module, b.module AS dst_module
  FROM edges e JOIN members a ON a.file = e.src JOIN members b ON b.file = e.dst WHERE a.module <> b.module)"""
ADJ = f"""{EDGES},
adj AS (SELECT src_module, dst_module, count(*) AS imports FROM medges GROUP BY ALL)"""
TURNS = """
once AS (
  SELECT conv_id, turn, min(struct_pack(role := role, text := text)) AS m FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
turns AS (
  SELECT conv_id, turn, coalesce(m.role, 'none') AS role, coalesce(m.text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM once),
noded AS (SELECT *, 'c' || conv_id || '.' || lpad(k::VARCHAR, 5, '0') AS node FROM turns)"""
VDOCS = f"""{TURNS},
pieces AS (
  SELECT conv_id, turn, '## Turn ' || turn || E'\\n\\n'
    || CASE WHEN role = 'assistant' AND conv_id % 2 = 0 THEN CASE WHEN conv_id % 5 = 0 THEN '' ELSE E'This diagram shows the steps.\\n\\n' END || E'```mermaid\\nflowchart TD\\nA[step one] --> B\\n```\\n\\n'
            WHEN role = 'assistant' THEN E'```python\\nprint(1)\\n```\\n\\n' ELSE '' END
    || text || E'\\n\\n[source](file:///' || role || '/' || conv_id || '.py'
    || CASE WHEN turn % 4 = 3 THEN '' ELSE '#L' || (turn + 1) || '-L' || (turn + 3) END
    || ') and [next](c' || (conv_id + 1) || '.md) and `call' || turn || E'`.\\n\\n' AS piece,
    (role = 'assistant')::INT AS answer
  FROM turns),
vdocs AS (
  SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'deep-dive' WHEN 1 THEN 'reference' ELSE 'concepts' END || '/c' || conv_id || '.md' AS path,
         '# Conversation ' || conv_id || E'\\n\\n' || CASE WHEN conv_id % 4 <> 0 THEN E'<details open>\\n<summary>Relevant source files</summary>\\n\\n</details>\\n\\n' ELSE '' END || string_agg(piece, '' ORDER BY turn) AS text,
         sum(answer) AS answers
  FROM pieces GROUP BY conv_id)"""


def hits(pattern: str, text: str = "text") -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


SOURCE, RANGED = r"file:///[^)\s#]+(?:#L\d+(?:-L?\d+)?)?", r"file:///[^)\s#]+#L\d+(?:-L?\d+)?"
METRICS = f"""{VDOCS},
metrics AS (
  SELECT conv_id, path, len(string_split(text, E'\\n')) AS line_count, {hits("(?m)^## ")} AS section_count, {hits("(?m)^### ")} AS subsection_count,
         {hits("```mermaid(?s:.*?)```")} AS diagram_count, {hits("classDiagram")} AS class_diagram_count,
         CASE WHEN conv_id % 2 = 0 THEN greatest(answers - 1, 0) ELSE answers END::BIGINT AS code_example_count,
         {hits(r"(?m)^\|[\s\-:|]+\|[\s\-:|]*$")} AS table_count, (SELECT count(*) FROM turns t WHERE t.conv_id = vdocs.conv_id) AS cross_link_count,
         regexp_matches(text, 'file:///[^)\\s#]+') AS has_source_tracing, conv_id % 4 <> 0 AS has_relevant_source_files,
         ({hits("🟢")} + {hits("🟡")} + {hits("🔴")}) AS confidence_count,
         {any_of("lower(text)", ["最佳实践", "best practice"])} AS has_best_practices, {any_of("lower(text)", ["性能优化", "性能考量", "performance"])} AS has_performance,
         {any_of("lower(text)", ["错误处理", "调试", "故障排除", "troubleshoot", "debug"])} AS has_troubleshooting
  FROM vdocs),
lnk AS (SELECT path, unnest(list_distinct(regexp_extract_all(text, '{SOURCE}'))) AS link FROM vdocs),
parts AS (
  SELECT path, regexp_replace(regexp_replace(link, '^file:///', ''), '#.*$', '') AS file, TRY_CAST(nullif(regexp_extract(link, '#L(\\d+)', 1), '') AS BIGINT) AS a, TRY_CAST(nullif(regexp_extract(link, '#L\\d+-L?(\\d+)', 1), '') AS BIGINT) AS b FROM lnk),
known AS (SELECT 'user/' || conv_id || '.py' AS file, conv_id % 7 + 2 AS lines FROM vdocs WHERE conv_id % 3 <> 2),
linked AS (
  SELECT path, count(*) FILTER (lines IS NOT NULL) AS valid, count(*) FILTER (lines IS NULL) AS broken, count(*) FILTER (a IS NULL) AS missing_lines,
         count(*) FILTER (lines IS NOT NULL AND a IS NOT NULL AND (a < 1 OR coalesce(b, a) > lines OR coalesce(b, a) < a)) AS invalid_lines
  FROM parts LEFT JOIN known USING (file) GROUP BY path),
judged AS (
  SELECT m.*, coalesce(valid, 0) AS valid, coalesce(broken, 0) AS broken, coalesce(missing_lines, 0) AS missing_lines, coalesce(invalid_lines, 0) AS invalid_lines,
    CASE WHEN path LIKE 'reference/%'
         THEN ((section_count >= 3)::INT + (code_example_count >= 1)::INT) / 2.0::DOUBLE * 50 + ((cross_link_count >= 1)::INT + (table_count >= 1)::INT + has_source_tracing::INT) / 3.0::DOUBLE * 30 + (has_best_practices::INT + (code_example_count >= 2)::INT + (class_diagram_count >= 1)::INT) / 3.0::DOUBLE * 20
         ELSE ((section_count >= 3)::INT + (code_example_count >= 1)::INT) / 2.0::DOUBLE * 50 + ((diagram_count >= 1)::INT + (cross_link_count >= 1)::INT + has_troubleshooting::INT) / 3.0::DOUBLE * 30 + (has_best_practices::INT + has_performance::INT + (class_diagram_count >= 1)::INT) / 3.0::DOUBLE * 20 END AS base
  FROM metrics m LEFT JOIN linked USING (path)),
levelled AS (
  SELECT *, CASE WHEN NOT has_source_tracing OR (valid = 0 AND broken > 0) THEN 'basic' WHEN base + CASE WHEN confidence_count >= 3 THEN 5 ELSE 0 END >= 80 THEN 'professional' WHEN base + CASE WHEN confidence_count >= 3 THEN 5 ELSE 0 END >= 50 THEN 'standard' ELSE 'basic' END AS quality_level FROM judged)"""
LINKS = """
links AS (
  SELECT page_id, unnest(t) AS target, unnest(range(len(t))) AS pos
  FROM (SELECT page_id, list_reverse(list_reduce(list_prepend([]::VARCHAR[], [[x] FOR x IN regexp_extract_all(coalesce(html, ''), '<a href="([^"]*)"', 1)]), lambda acc, x: CASE WHEN list_contains(acc, x[1]) THEN acc ELSE list_prepend(x[1], acc) END)) AS t FROM pages WHERE page_id IS NOT NULL))"""
PLAN = """
plan AS (
  SELECT page_id AS pos, 'page-' || CASE WHEN page_id % 10 = 9 THEN page_id - 1 ELSE page_id END AS page_id, CASE WHEN page_id % 6 = 0 THEN '' ELSE 'Title ' || page_id END AS title,
         CASE WHEN page_id % 15 = 7 THEN '../' ELSE 'pages/' END || page_id || CASE WHEN page_id % 25 = 3 THEN '.txt' ELSE '.md' END AS output_path,
         list_extract(['overview', 'concept', 'deep-dive', 'reference', 'custom'], CAST(page_id % 5 AS INT) + 1) AS page_type, page_id AS n
  FROM pages WHERE page_id IS NOT NULL),
labelled AS (SELECT *, CASE page_type WHEN 'overview' THEN 'Overview' WHEN 'concept' THEN 'Concepts' WHEN 'deep-dive' THEN 'Deep Dive' WHEN 'reference' THEN 'Reference' ELSE 'More' END AS section, coalesce(nullif(title, ''), page_id) AS shown FROM plan)"""

_GAPS = [*R.MODULE_REQUIRED, *R.MODULE_COGNITIVE]

ORACLE_SQL = {
    "inventory_files": f"WITH {INV} SELECT path, name, extension, size, hash, category, language, category = 'test' AS is_test, category = 'config' AS is_config, category = 'doc' AS is_doc, is_generated, depth FROM inv",
    "inventory_stats": f"""WITH {INV} SELECT count(*) AS total_files, count(*) FILTER (category = 'code') AS code_files, count(*) FILTER (category = 'test') AS test_files, count(*) FILTER (category = 'config') AS config_files,
        count(*) FILTER (category = 'doc') AS doc_files, count(*) FILTER (is_generated) AS generated_files, coalesce(max(depth), 0) AS max_depth, coalesce(string_agg(DISTINCT language, ',' ORDER BY language), '') AS languages FROM inv""",
    "entry_and_config": f"""WITH {INV} SELECT path, 'entry' AS role, 'main-like filename' AS detail FROM inv WHERE name IN ({q(R.ENTRY_NAMES)})
        UNION ALL SELECT path, 'config', CASE name {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.CONFIG_KIND.items())} END FROM inv WHERE name IN ({q(R.CONFIG_KIND)})""",
    "managers_by_module": f"""WITH {INV} SELECT module, {", ".join(f"bool_or(name IN ({q(n)})) AS uses_{m}" for m, n in R.PACKAGE_MANAGERS)}, bool_or(name = 'next.config.js') AS nextjs,
        bool_or(name IN ('vite.config.ts', 'vite.config.js')) AS vite, bool_or(name = 'manage.py') AS django, bool_or(path LIKE 'app/%') AND bool_or(name = 'package.json') AS frontend_app FROM inv GROUP BY module""",
    "ext_histogram": f"WITH {INV} SELECT extension, count(*) AS files FROM inv WHERE extension IN ({q(R.CODE_SUFFIXES)}) GROUP BY extension",
    "size_buckets": f"""WITH {VFILES}, b(bucket, low, high) AS (VALUES ('tiny', -1, 1024), ('small', 1024, 10240), ('medium', 10240, 51200), ('large', 51200, 9000000000000000000))
        SELECT bucket, (SELECT count(*) FROM vfiles WHERE size >= low AND size < high) AS files FROM b""",
    "language_rank": f"""WITH {VFILES} SELECT language, count(*) AS files, place FROM vfiles JOIN (VALUES {", ".join(f"('{s}', '{n}', {i})" for i, (n, own) in enumerate(R.LANGUAGE_SUFFIXES) for s in own)}) l(extension, language, place) USING (extension) GROUP BY ALL""",
    "code_purpose": f"WITH {VFILES} SELECT doc_id, {PURPOSE} AS purpose FROM vfiles",
    "module_type": "SELECT p_partkey, CASE " + " ".join(f"WHEN {any_of(chr(108) + 'ower(coalesce(p_name, ' + repr('') + '))', m)} THEN '{k}'" for k, m in R.MODULE_KINDS) + " ELSE 'module' END AS kind FROM part",
    "importance_score": f"WITH {SCORED} SELECT doc_id, path_score, identity_score, lang_score, size_score, degree_score, total, importance_score, is_core, is_high_priority FROM raw_ranked",
    "module_percentile": f"WITH {NORMAL} SELECT doc_id, module, percentile, path_score_normalized, importance_score FROM ranked",
    "dynamic_thresholds": f"WITH {NORMAL} SELECT core, high FROM cuts",
    "module_scores": f"""WITH {NORMAL}, cored AS (SELECT module, path, row_number() OVER (PARTITION BY module ORDER BY path) AS rn FROM flagged WHERE is_core)
        SELECT f.module, count(*) AS files, CAST(printf('%.2f', sum(round(importance_score * 100)::BIGINT) / 100.0::DOUBLE / count(*)) AS DOUBLE) AS importance_score,
               coalesce(any_value(c.n), 0) AS core_files_count, coalesce(any_value(c.core_files), '') AS core_files
        FROM flagged f LEFT JOIN (SELECT module, count(*) AS n, string_agg(path, ',' ORDER BY path) AS core_files FROM cored WHERE rn <= {R.MAX_CORE_FILES} GROUP BY module) c ON c.module = f.module GROUP BY f.module""",
    "directory_scores": f"""WITH {VFILES}, folders AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, extension IN ({q(R.CODE_SUFFIXES)}) AS code FROM vfiles),
        split AS (SELECT folder, code, string_split(folder, '/') AS p FROM folders),
        chain AS (SELECT folder, code, array_to_string(p[1:n], '/') AS path FROM (SELECT *, unnest(range(1, len(p) + 1)) AS n FROM split)),
        every AS (SELECT path, count(*) FILTER (path = folder AND code) AS file_count FROM chain GROUP BY path),
        subs AS (SELECT regexp_replace(path, '/[^/]*$', '') AS path, count(*) AS subs FROM every WHERE contains(path, '/') AND regexp_extract(path, '[^/]*$') NOT IN ({q(R.MORE_IGNORED_DIRS)}) GROUP BY 1),
        named AS (SELECT e.path, regexp_extract(e.path, '[^/]*$') AS name, file_count, coalesce(subs, 0) AS subdirectory_count FROM every e LEFT JOIN subs s ON s.path = e.path)
        SELECT *, least(CASE WHEN name IN ('src', 'lib', 'pkg', 'cmd', 'internal') THEN 4 ELSE 0 END + CASE WHEN {any_of("lower(name)", ["core", "main", "engine", "kernel"])} THEN 3 ELSE 0 END
               + CASE WHEN file_count > 5 THEN 2 WHEN file_count > 0 THEN 1 ELSE 0 END + CASE WHEN subdirectory_count > 2 THEN 1 ELSE 0 END, 10) / 10.0::DOUBLE AS importance_score FROM named""",
    "context_budget": f"""WITH {NORMAL}, costed AS (
          SELECT path, importance_score, is_core AND doc_id % 3 = 0 AS is_core, is_high_priority, greatest(size // CASE extension {" ".join(f"WHEN '{k}' THEN {v}" for k, v in R.TOKEN_RATIOS.items())} ELSE 4 END, 100) AS cost, extension IN ({q(R.CODE_SUFFIXES)}) AS code FROM flagged),
        one AS (SELECT coalesce(sum(cost) FILTER (code), 0)::BIGINT AS code_tokens, count(*) FILTER (is_core) AS quick_files, coalesce(sum(cost // 10) FILTER (is_core), 0)::BIGINT AS quick_cost FROM costed),
        two AS (SELECT *, greatest(CASE WHEN code_tokens < 100000 THEN 50000 WHEN code_tokens < 1000000 THEN 150000 ELSE 300000 END, least(CASE WHEN code_tokens < 100000 THEN 200000 WHEN code_tokens < 1000000 THEN 400000 ELSE 600000 END, floor(code_tokens * 0.3::DOUBLE)))::BIGINT AS total_budget FROM one),
        three AS (SELECT *, floor(total_budget * 0.33::DOUBLE)::BIGINT AS reserved, total_budget - floor(total_budget * 0.33::DOUBLE)::BIGINT AS available FROM two),
        running AS (SELECT sum(cost) OVER (ORDER BY importance_score DESC, path ROWS UNBOUNDED PRECEDING) AS s FROM costed WHERE is_high_priority AND NOT is_core),
        fits AS (SELECT count(*) AS deep_files, coalesce(max(s), 0)::BIGINT AS deep_cost FROM running, three WHERE s <= available - quick_cost)
        SELECT code_tokens, quick_files, quick_cost, total_budget, reserved, available, deep_files, deep_cost, available - quick_cost - deep_cost AS remaining FROM three, fits""",
    "analysis_depth": f"""WITH {VFILES}, m AS (SELECT doc_id, path, len(list_filter(string_split(text, E'\\n'), lambda x: NOT regexp_matches(trim(x, ' '), '^(#|//|/\\*|\\*)') AND NOT regexp_matches(x, '^\\s*$'))) AS loc FROM vfiles),
        d AS (SELECT *, least(floor(loc * 2 * 100 / 10.0::DOUBLE), 100) AS complexity, {PURPOSE} AS purpose FROM m)
        SELECT doc_id, CASE WHEN complexity >= 30 OR loc >= 20 THEN 'deep' WHEN complexity >= 15 OR loc >= 8 OR purpose IN ({q(R.STANDARD_PURPOSES)}) OR doc_id % 4 = 0 THEN 'standard' ELSE 'quick' END AS depth FROM d""",
    "token_costs": f"""WITH {VFILES}, r AS (SELECT doc_id, size, CASE extension {" ".join(f"WHEN '{k}' THEN {v}" for k, v in R.TOKEN_RATIOS.items())} ELSE 4 END::BIGINT AS ratio FROM vfiles) SELECT doc_id, greatest(size // ratio, 100)::BIGINT AS cost, ratio FROM r""",
    "snapshot_diff": f"WITH {SNAPSHOTS} SELECT path, status FROM diffed",
    "change_types": f"""WITH {SNAPSHOTS} SELECT d.path, status, CASE WHEN status = 'added' THEN 'new' WHEN status = 'deleted' THEN 'deleted' WHEN extension IN ({q(R.TEXT_DOC_SUFFIXES)}) THEN 'doc-only-change'
        WHEN {" OR ".join(f"contains(text, E'{m.replace(chr(9), chr(92) + 't')}')" for m in R.API_MARKS)} THEN 'api-change' ELSE 'impl-change' END AS change_type FROM diffed d JOIN vfiles USING (path) WHERE status <> 'unchanged'""",
    "affected_modules": f"WITH {SNAPSHOTS} SELECT DISTINCT module FROM diffed JOIN vfiles USING (path) WHERE status <> 'unchanged'",
    "affected_pages": f"WITH {VFILES} SELECT DISTINCT split_part(module, '/', 1) AS page_id FROM vfiles WHERE module IN (SELECT module FROM vfiles WHERE doc_id % 13 = 0)",
    "reverse_propagation": f"""WITH {EDGES} SELECT DISTINCT src_module AS name FROM medges, (VALUES ('nation1/'), ('nation3/')) f(folder)
        WHERE src_module NOT IN ('nation1', 'nation3') AND (starts_with(dst_module || '/x/', folder) OR starts_with(folder, dst_module || '/x/') OR starts_with(dst_module || '/x', folder) OR starts_with(folder, dst_module || '/x'))""",
    "upsert_merge": f"""WITH {VFILES}, parts AS (SELECT path, 'part1' AS origin, size + 1 AS size, 1 AS part FROM vfiles WHERE doc_id % 2 = 0 UNION ALL SELECT path, 'part2', size + 2, 2 FROM vfiles WHERE doc_id % 5 = 0),
        last AS (SELECT path, origin, size FROM parts QUALIFY row_number() OVER (PARTITION BY path ORDER BY part DESC) = 1)
        SELECT path, 'stored' AS origin, size FROM vfiles WHERE doc_id % 3 <> 0 AND path NOT IN (SELECT path FROM last) UNION ALL SELECT * FROM last""",
    "import_in_degree": f"WITH {EDGES} SELECT dst, count(*) AS in_degree, least(count(*) / 10.0::DOUBLE, 1.0::DOUBLE) AS degree_score FROM edges GROUP BY dst",
    "module_adjacency": f"WITH {ADJ} SELECT * FROM adj",
    "cross_density": f"""WITH {ADJ}, sizes AS (SELECT module, count(*) AS files FROM members GROUP BY module),
        pairs AS (SELECT least(src_module, dst_module) AS module_a, greatest(src_module, dst_module) AS module_b, coalesce(sum(imports) FILTER (src_module < dst_module), 0)::BIGINT AS a_to_b, coalesce(sum(imports) FILTER (src_module > dst_module), 0)::BIGINT AS b_to_a FROM adj GROUP BY ALL),
        d AS (SELECT p.*, (a_to_b + b_to_a)::DOUBLE / (x.files + y.files) AS density FROM pairs p JOIN sizes x ON x.module = module_a JOIN sizes y ON y.module = module_b)
        SELECT *, density > 0.5 AND a_to_b > 0 AND b_to_a > 0 AS merge FROM d""",
    "dependency_hints": f"""WITH {ADJ}, both_ways AS (SELECT src_module AS module, dst_module AS i, NULL AS b FROM adj UNION ALL SELECT dst_module, NULL, src_module FROM adj)
        SELECT module, coalesce(string_agg(DISTINCT i, ',' ORDER BY i), '') AS imports, coalesce(string_agg(DISTINCT b, ',' ORDER BY b), '') AS imported_by FROM both_ways GROUP BY module""",
    "import_filter": f"""WITH {EDGES}, own AS (SELECT file FROM members WHERE module = 'nation1') SELECT src, dst, CASE WHEN src IN (FROM own) THEN 'out' ELSE 'in' END AS direction FROM edges WHERE src IN (FROM own) OR dst IN (FROM own)""",
    "module_components": f"WITH {TURNS} SELECT node, min(node) OVER (PARTITION BY conv_id) AS component FROM noded",
    "split_hints": f"""WITH {TURNS}, sizes AS (SELECT 'm' || conv_id % 10 AS module, conv_id, count(*) AS n FROM turns GROUP BY ALL)
        SELECT module, count(*) AS components, max(n) AS largest, sum(n)::BIGINT AS files, max(n) < sum(n) * 0.5::DOUBLE AS split FROM sizes GROUP BY module""",
    "bfs_sequences": f"""WITH {TURNS}, lone AS (SELECT conv_id FROM turns GROUP BY conv_id HAVING count(*) > 1)
        SELECT 'c' || conv_id || '.00000' AS start, node, ((k + 1) // 2)::INT AS depth, k AS ord FROM noded JOIN (SELECT conv_id, max(k) AS last FROM turns GROUP BY conv_id) USING (conv_id) WHERE conv_id IN (FROM lone) AND (k + 1) // 2 <= {R.MAX_DEPTH} AND k < last""",
    "architecture_layers": f"""WITH {VFILES}, p AS (SELECT module || '/' || split_part(path, '/', 3) AS module, coalesce(list_position([{q(R.PURPOSE_ORDER)}], {PURPOSE}), {len(R.PURPOSE_ORDER)}) AS place FROM vfiles),
        best AS (SELECT module, list_extract([{q(R.PURPOSE_ORDER)}], min(place)) AS purpose FROM p GROUP BY module),
        l AS (SELECT module, layer, place FROM best JOIN (VALUES {", ".join(f"('{p}', '{n}', {i})" for i, (n, own) in enumerate(R.LAYERS) for p in own)}) v(purpose, layer, place) USING (purpose))
        SELECT layer, string_agg(module, ',' ORDER BY module) AS modules, count(*) AS n, place FROM l GROUP BY layer, place""",
    "dominant_purpose": f"""WITH {VFILES}, n AS (SELECT module AS "group", {PURPOSE} AS purpose, count(*) AS n FROM vfiles GROUP BY ALL) SELECT "group", purpose, n FROM n QUALIFY row_number() OVER (PARTITION BY "group" ORDER BY n DESC, purpose) = 1""",
    "bidirectional_sections": f"""WITH {ADJ}, s AS (SELECT right(src_module, 1) AS a, right(dst_module, 1) AS b FROM adj) SELECT least(a, b) AS section_a, greatest(a, b) AS section_b FROM s WHERE a <> b GROUP BY ALL HAVING count(*) >= 2""",
    "page_links_broken": f"""WITH {VDOCS}, l AS (SELECT DISTINCT v.path, 'c' || (v.conv_id + 1) || '.md' AS target, regexp_extract(v.path, '^[^/]+') || '/c' || (v.conv_id + 1) || '.md' AS beside FROM vdocs v)
        SELECT path, target FROM l WHERE beside NOT IN (SELECT path FROM vdocs)
        UNION ALL SELECT DISTINCT v.path, 'file:///' || role || '/' || v.conv_id || '.py' || CASE WHEN turn % 4 = 3 THEN '' ELSE '#L' || (turn + 1) || '-L' || (turn + 3) END FROM vdocs v JOIN turns t ON t.conv_id = v.conv_id""",
    "unlisted_pages": f"""WITH {LINKS} SELECT DISTINCT target || '.md' AS file FROM links WHERE target || '.md' NOT IN (SELECT target || '.md' FROM links WHERE page_id % 2 = 0) AND target || '.md' NOT IN ({q(R.TOP_LEVEL_PAGES)}) AND EXISTS (SELECT 1 FROM links WHERE page_id % 2 = 0)""",
    "doc_metrics": f"WITH {METRICS} SELECT * EXCLUDE (conv_id) FROM metrics",
    "doc_quality_current": f"""WITH {VDOCS}, m AS (SELECT conv_id, path, len(string_split(regexp_replace(text, E'\\n$', ''), E'\\n')) AS line_count, {hits(r"(?m)^##\s+")} AS section_count, {hits("```mermaid(?s:.*?)```")} AS diagram_count, {hits(SOURCE)} AS source_link_count, {hits(RANGED)} AS source_link_with_lines_count, contains(text, '|') AS bar FROM vdocs),
        i AS (SELECT *, array_to_string(list_filter([CASE WHEN conv_id % 4 = 0 THEN 'H1 must be followed by an open Relevant source files/相关源文件 block.' END, CASE WHEN source_link_count = 0 THEN 'Document must include file:/// source tracing links.' END,
            CASE WHEN source_link_count <> source_link_with_lines_count THEN 'All file:/// source links must include #L line ranges.' END, CASE WHEN diagram_count > 0 AND conv_id % 5 = 0 THEN 'Every Mermaid diagram must have a short explanatory paragraph before it.' END], lambda x: x IS NOT NULL), '; ') AS issues,
            array_to_string(list_filter([CASE WHEN section_count < 1 THEN 'Document should include at least one H2 section.' END, CASE WHEN diagram_count = 0 AND NOT bar THEN 'Document should include a Mermaid diagram or a structured table.' END], lambda x: x IS NOT NULL), '; ') AS warnings FROM m),
        s AS (SELECT * EXCLUDE (conv_id, bar), (100 - 30 * CASE WHEN issues = '' THEN 0 ELSE len(string_split(issues, '; ')) END - 10 * CASE WHEN warnings = '' THEN 0 ELSE len(string_split(warnings, '; ')) END)::BIGINT AS score FROM i)
        SELECT *, CASE WHEN score >= 85 THEN 'professional' WHEN score >= 60 THEN 'standard' ELSE 'basic' END AS quality_level FROM s""",
    "doc_quality_archived": f"WITH {METRICS} SELECT path, quality_level FROM levelled",
    "expected_metrics": f"""WITH {VDOCS}, t AS (SELECT path, CASE WHEN conv_id % 10 > 1 THEN 'default' WHEN conv_id % 9 / 10.0::DOUBLE >= 0.6 THEN 'high' WHEN conv_id % 9 / 10.0::DOUBLE >= 0.4 THEN 'middle' ELSE 'low' END AS tier FROM vdocs)
        SELECT path, min_lines, min_sections, min_diagrams, min_examples FROM t JOIN (VALUES ('high', 200::INT, 8::INT, 2::INT, 3::INT), ('middle', 120, 6, 1, 2), ('low', 80, 5, 1, 2), ('default', 100, 6, 1, 2)) v(tier, min_lines, min_sections, min_diagrams, min_examples) USING (tier)""",
    "doc_issues": f"""WITH {METRICS} SELECT path, ((line_count < 100)::INT + (section_count < 6)::INT + (diagram_count < 1)::INT + (code_example_count < 2)::INT + (NOT has_source_tracing)::INT + (path NOT LIKE 'reference/%' AND NOT has_relevant_source_files)::INT
        + (broken > 0)::INT + (missing_lines > 0)::INT + (invalid_lines > 0)::INT + (cross_link_count < 1)::INT
        + CASE WHEN quality_level = 'standard' THEN (NOT has_best_practices)::INT + (NOT has_performance)::INT + (confidence_count < 3)::INT ELSE 0 END)::BIGINT AS issues FROM levelled""",
    "quality_rollup": f"""WITH {METRICS} SELECT count(*) AS total, count(*) FILTER (quality_level = 'professional') AS professional, count(*) FILTER (quality_level = 'standard') AS standard, count(*) FILTER (quality_level = 'basic') AS basic,
        CASE WHEN count(*) FILTER (quality_level = 'basic') * 2 > count(*) THEN 2 WHEN count(*) FILTER (quality_level = 'basic') > 0 THEN 1 ELSE 0 END AS exit_code FROM levelled""",
    "source_link_lines": f"WITH {METRICS} SELECT * FROM linked",
    "interface_coverage": f"""WITH {TURNS} SELECT t.conv_id AS source, t.conv_id + 1 AS target, 'call' || t.turn AS interface FROM turns t WHERE t.conv_id + 1 IN (SELECT conv_id FROM turns)
        AND NOT EXISTS (SELECT 1 FROM turns n WHERE n.conv_id = t.conv_id + 1 AND n.turn = t.turn)""",
    "related_pages": f"""WITH {PLAN}, d AS (SELECT page_id AS a, 'page-' || n // 2 AS b FROM plan WHERE n % 4 = 1), e AS (SELECT a AS page_id, b AS other FROM d UNION SELECT b, a FROM d)
        SELECT page_id, string_agg(DISTINCT other, ',' ORDER BY other) AS related FROM e WHERE page_id <> other GROUP BY page_id""",
    "page_excerpts": f"""WITH {VFILES}, t AS (SELECT 'p' || doc_id AS page_id, CASE WHEN doc_id % 6 = 0 THEN path || '.gone' ELSE path END AS target, CASE WHEN doc_id % 6 <> 0 THEN substr(text, 1, {R.EXCERPT_CHARS}) END AS e FROM vfiles)
        SELECT page_id, target, length(e)::INT AS chars, CASE WHEN e IS NOT NULL THEN 1::BIGINT END AS start_line, (length(e) - length(replace(e, E'\\n', '')) + 1)::BIGINT AS end_line, CASE WHEN e IS NULL THEN 'Source target not readable: ' || target END AS "constraint" FROM t""",
    "snippets": f"""WITH {VFILES}, l AS (SELECT doc_id, regexp_extract_all(text, E'[^\\n]*\\n|[^\\n]+$') AS rows FROM vfiles), s AS (SELECT doc_id, coalesce(array_to_string(rows[1:5], ''), '') AS s FROM l),
        c AS (SELECT doc_id, CASE WHEN length(s) > {R.SNIPPET_CHARS} THEN substr(s, 1, {R.SNIPPET_CHARS}) || E'\\n// ... (truncated)' ELSE s END AS s FROM s) SELECT doc_id, sha256(s) AS snippet_sha256, length(s)::INT AS chars FROM c""",
    "source_lines": f"""WITH {VFILES}, l AS (SELECT doc_id, unnest(string_split(text, E'\\n')) AS t, unnest(range(1, len(string_split(text, E'\\n')) + 1)) AS number FROM vfiles) SELECT doc_id, number::INT AS number, md5(t) AS text_md5, number BETWEEN 2 AND 3 AS highlight FROM l""",
    "menu_from_seed": f"""WITH {PLAN}, last AS (SELECT page_id, shown, output_path FROM labelled QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos DESC) = 1),
        seed AS (SELECT page_type AS section, row_number() OVER (PARTITION BY page_type ORDER BY pos) AS pos, 'page-' || pos AS page_id FROM plan)
        SELECT section, s.pos::INT AS pos, shown AS title, output_path AS path FROM seed s JOIN last USING (page_id)""",
    "menu_by_type": f"WITH {PLAN} SELECT min(pos) OVER (PARTITION BY page_type) AS section_pos, section, pos, shown AS title, output_path AS path FROM labelled",
    "menu_prev_next": f"WITH {PLAN} SELECT section, output_path AS path, lag(output_path) OVER w AS previous, lead(output_path) OVER w AS next FROM labelled WHERE pos % 8 <> 2 WINDOW w AS (PARTITION BY section ORDER BY pos)",
    "menu_dedupe": f"WITH {LINKS} SELECT page_id % 5 AS section, min(page_id * 1000 + pos) AS pos, target AS path FROM links WHERE target <> '' GROUP BY ALL UNION ALL SELECT page_id % 5, page_id * 1000 + pos, target FROM links WHERE target = ''",
    "menu_redundant": f"""WITH {LINKS}, g AS (SELECT DISTINCT list_extract([{q([*R.BUILTIN_GROUPS, "own"])}], CAST(page_id % 6 AS INT) + 1) AS "group", CASE WHEN page_id % 6 = 2 THEN target ELSE 'p' || pos END AS path FROM links), n AS (SELECT *, count(*) OVER (PARTITION BY path) AS spread FROM g)
        SELECT "group" FROM n WHERE "group" <> 'own' GROUP BY "group" HAVING min(spread) > 1""",
    "plan_validation": f"""WITH {PLAN}, ord AS (SELECT page_id FROM plan WHERE pos % 12 <> 1 UNION SELECT page_id || '-x' FROM plan WHERE pos % 40 = 0)
        SELECT 'pages[' || pos || '] missing fields: status, title' AS message FROM plan WHERE pos % 30 = 11
        UNION ALL SELECT 'pages[' || pos || '] output_path is unsafe or not markdown: ' || output_path FROM plan WHERE pos % 15 = 7 OR pos % 25 = 3
        UNION ALL SELECT 'pages[' || pos || '] source_targets must be non-empty' FROM plan WHERE pos % 20 = 5
        UNION ALL SELECT 'duplicate page_id: ' || page_id FROM plan GROUP BY page_id HAVING count(*) > 1
        UNION ALL SELECT 'duplicate output_path: ' || output_path FROM plan GROUP BY output_path HAVING count(*) > 1
        UNION ALL SELECT DISTINCT 'generation_order misses: ' || page_id FROM plan WHERE page_id NOT IN (FROM ord)
        UNION ALL SELECT 'generation_order has unknown: ' || page_id FROM ord WHERE page_id NOT IN (SELECT page_id FROM plan)""",
    "doc_topology": f"""WITH m AS (SELECT p_partkey AS n, 'mod-' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '_x' ELSE '' END AS name, list_extract(['Entry', 'Dao', 'Service', 'Util', ''], CAST(p_partkey % 5 AS INT) + 1) AS purpose,
          CASE p_partkey % 3 WHEN 0 THEN 'pkg' || p_partkey % 7 WHEN 1 THEN 'a' || p_partkey % 4 END AS package FROM part)
        SELECT 'deep-dive:' || coalesce(package || '/', '') || name AS id, CASE WHEN purpose IN ('Dao', 'Util') THEN 'internal' ELSE 'capability' END AS type,
               CASE WHEN n % 4 = 0 THEN 'Group ' || n % 9 ELSE 'Mod ' || n || CASE WHEN n % 2 = 0 THEN ' X' ELSE '' END END AS title,
               'wiki/deep-dive/' || coalesce(package || '/mod_' || n, name) || '.md' AS output_path, package AS package_group,
               CASE n % 3 WHEN 0 THEN 'packages/' || package || '/src/' WHEN 1 THEN 'apps/' || package || '/' ELSE 'src/' END || 'mod_' || n AS source_module FROM m
        UNION ALL SELECT *, NULL, NULL FROM (VALUES {", ".join(f"({q(p)})" for p in R.STATIC_PAGES)})""",
    "evidence_claims": f"""WITH {VFILES}, l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id),
        m AS (SELECT path, text AS module_summary, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'role ' || doc_id END AS module_role, CASE WHEN q = 1 THEN 'high' ELSE 'low' END AS confidence FROM vfiles LEFT JOIN l USING (doc_id))
        SELECT 'deep-dive:' || path || ':module_summary' AS claim_id, 'deep-dive:' || path AS page_id, module_summary AS claim_text, confidence FROM m WHERE module_summary <> ''
        UNION ALL SELECT 'deep-dive:' || path || ':module_role', 'deep-dive:' || path, module_role, confidence FROM m WHERE module_role <> ''""",
    "mermaid_repair": f"""WITH {VDOCS}, b AS (SELECT conv_id, text, CASE WHEN conv_id % 2 = 0 THEN answers ELSE 0 END::BIGINT AS n FROM vdocs)
        SELECT conv_id, n AS blocks, n AS changed, n AS fixes, sha256(CASE WHEN n > 0 THEN replace(text, 'flowchart TD' || chr(10) || 'A[step one]', 'flowchart TD' || chr(10) || 'A["step one"]') ELSE text END) AS text_sha256 FROM b""",
    "missing_required_fields": f"""WITH {VFILES}, m AS (SELECT path, array_to_string(list_filter([{", ".join(f"CASE WHEN doc_id % {i + 3} <= 1 THEN '{c}' END" for i, c in enumerate(_GAPS))}], lambda x: x IS NOT NULL), ',') AS missing FROM vfiles) SELECT * FROM m WHERE missing <> ''""",
    "toc": """WITH h AS (SELECT page_id, regexp_extract_all(replace(replace(coalesce(html, ''), '<h1>', '<h2>'), '</h1>', '</h2>'), '(?is)<h2[^>]*>.*?</h2>') AS h FROM pages WHERE page_id IS NOT NULL),
        u AS (SELECT page_id, unnest(h) AS x, unnest(range(len(h))) AS pos FROM h) SELECT page_id, pos::INT AS pos, 2::INT AS level, trim(regexp_replace(x, '<[^>]+>', '', 'g'), ' ') AS text FROM u""",
    "line_metrics": f"""WITH {VFILES}, m AS (SELECT doc_id, string_split(text, E'\\n') AS l, len(string_split_regex(text, '\\bif\\b')) - 1 AS cf, len(string_split(text, 'the ')) - 1 AS df FROM vfiles),
        c AS (SELECT doc_id, len(list_filter(l, lambda x: NOT regexp_matches(trim(x, ' '), '^(#|//|/\\*|\\*)') AND NOT regexp_matches(x, '^\\s*$'))) AS loc, len(list_filter(l, lambda x: regexp_matches(x, '(?:TODO|FIXME|HACK|NOTE|WARN|XXX)\\s*[:\\(]'))) AS todo, cf, df FROM m)
        SELECT doc_id, loc, todo, least(floor((cf * 2 + df) * 100 / greatest(loc, 1)::DOUBLE), 100)::BIGINT AS complexity FROM c""",
}
