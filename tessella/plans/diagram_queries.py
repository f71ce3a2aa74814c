"""Queries over diagrams of every kind: each conversation's document gets two more diagrams, which its number chooses, with
planted faults of each rule. What must come out of a diagram is written down, by hand, for both sets of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import diagrams
from tessella.plans import bind
from tessella.plans.oracle import VDOCS
from tessella.session import ship

#: (diagram, repaired by the archived rules, number of repairs, repaired by the current rules, number of repairs).
#: @N@ is the conversation's number.
PLANTED = [
    (
        "flowchart TD\n    A[Data @N@ in] -->|error handler| B{is ok?}\n    api-gw(POST /a) --> DB[(SQLite DB)]\n    C[Plain] --> D[/ws/chat]\n",
        'flowchart TD\n    A["Data @N@ in"] -->|"error handler"| B{"is ok?"}\n    api-gw("POST /a") --> DB[("SQLite DB")]\n    C[Plain] --> D["/ws/chat"]\n', 6,
        'flowchart TD\n    A["Data @N@ in"] -->|"error handler"| B{"is ok?"}\n    api-gw("POST /a") --> DB[("SQLite DB")]\n    C[Plain] --> D["/ws/chat"]\n', 6,
    ),
    (
        'graph LR\n    A["run("x, y")"] --> B[one]\n    B[two words] --> C\n    B --> D\n',
        "graph LR\n    A[\"run('x, y')\"] --> B[one]\n    B_2[\"two words\"] --> C\n    B_2 --> D\n", 3,
        'graph LR\n    A["run("x, y")"] --> B[one]\n    B["two words"] --> C\n    B --> D\n', 1,
    ),
    (
        "sequenceDiagram\nparticipant P as My Service @N@\nactor U as User\nP->>U:send request\nU-->>P:ok\n",
        'sequenceDiagram\nparticipant P as "My Service @N@"\nactor U as User\nP->>U:"send request"\nU-->>P:ok\n', 2,
        'sequenceDiagram\nparticipant P as "My Service @N@"\nactor U as User\nP->>U:send request\nU-->>P:ok\n', 1,
    ),
    (
        'classDiagram\n    class "Model~TApi~" {\n        +Record~string,string~ headers\n        -Map~string, Api~ registry\n        +process data()\n        +result() Promise~Message~\n    }\n    class Plain {\n        +go()\n    }\n    Plain --> Other@N@ : uses it all\n    Model~TApi~ : "tagged with"\n',
        'classDiagram\n    class "Model<TApi>" as Model {\n        +Record<string, string> headers\n        -Map<string, Api> registry\n        +"process data"()\n        +result() Promise<Message>\n    }\n    class Plain {\n        +go()\n    }\n    Plain --> Other@N@ : "uses it all"\n    Model : "tagged with"\n', 7,
        'classDiagram\n    class "Model<TApi>" as Model {\n        +Record~string,string~ headers\n        -Map~string, Api~ registry\n        +process data()\n        +result() Promise~Message~\n    }\n    class Plain {\n        +go()\n    }\n    Plain --> Other@N@ : uses it all\n    Model~TApi~ : "tagged with"\n', 1,
    ),
    (
        "erDiagram\n    LINE.ITEM@N@ ||--o{ ORDER : places\n    ORDER ||--|{ A-B : has\n",
        "erDiagram\n    LINE_ITEM@N@ ||--o{ ORDER : places\n    ORDER ||--|{ A-B : has\n", 1,
        "erDiagram\n    LINE.ITEM@N@ ||--o{ ORDER : places\n    ORDER ||--|{ A-B : has\n", 0,
    ),
    ("stateDiagram-v2\n    [*] --> Idle\n    Idle --> Run : go on @N@\n", "stateDiagram-v2\n    [*] --> Idle\n    Idle --> Run : go on @N@\n", 0, "stateDiagram-v2\n    [*] --> Idle\n    Idle --> Run : go on @N@\n", 0),
    (
        "flowchart LR\n    Start(HTTP @N@ 请求) --> Decision{是否成功?}\n    Decision -->|yes| Store[(DB)]\n    Decision -->|no way| Start\n    style Store fill:#f9f,stroke:#333\n",
        'flowchart LR\n    Start("HTTP @N@ 请求") --> Decision{"是否成功?"}\n    Decision -->|yes| Store[(DB)]\n    Decision -->|"no way"| Start\n    style Store fill:#f9f,stroke:#333\n', 3,
        'flowchart LR\n    Start("HTTP @N@ 请求") --> Decision{"是否成功?"}\n    Decision -->|yes| Store[(DB)]\n    Decision -->|"no way"| Start\n    style Store fill:#f9f,stroke:#333\n', 3,
    ),
    ('pie title Languages\n"Python" : 4@N@\n', 'pie title Languages\n"Python" : 4@N@\n', 0, 'pie title Languages\n"Python" : 4@N@\n', 0),
]
#: The same kinds as they are named in reports.
KINDS = ["flowchart", "graph", "sequenceDiagram", "classDiagram", "erDiagram", "stateDiagram-v2", "flowchart", "unknown"]


def documents(spark, sf) -> DataFrame:
    """(conv_id, text): vdocs, each with two planted diagrams at its end."""
    docs, n = bind.vdocs(ship(spark), sf), F.col("conv_id")
    planted = F.array(*(F.lit(p[0]) for p in PLANTED))
    pick = lambda k: F.replace(F.element_at(planted, (k % len(PLANTED) + 1).cast("int")), F.lit("@N@"), n.cast("string"))
    return docs.select("conv_id", F.concat("text", F.lit("\n```mermaid\n"), pick(n), F.lit("```\n\nThe next shows it, too.\n\n```mermaid\n"), pick(F.floor(n / len(PLANTED))), F.lit("```\n")).alias("text"))


def _repaired(spark, sf, thorough: bool) -> DataFrame:
    done = documents(spark, sf).select("conv_id", diagrams.repair(F.col("text"), thorough).alias("r"))
    return done.select("conv_id", "r.blocks", "r.changed", "r.fixes", F.sha2("r.text", 256).alias("text_sha256"))


def diagram_repair(spark, sf):
    """Flow, sequence, class, entity, state and other diagrams by the archived rules: quoted labels,
    quotes within quotes, ids given twice, generic names and what refers to them, entity names; states stay."""
    return _repaired(spark, sf, True)


def diagram_repair_current(spark, sf):
    """The same documents by the current rules."""
    return _repaired(spark, sf, False)


def diagram_kinds(spark, sf):
    """Every diagram of a document with its kind, and how many lines it has."""
    rows = documents(spark, sf).select("conv_id", F.inline(diagrams.blocks(F.col("text"), F.concat(F.lit("c"), F.col("conv_id").cast("string")))))
    return rows.select("conv_id", "block_id", "diagram_type", F.regexp_count("text", F.lit("\n")).alias("lines"))


QUERIES = {f.__name__: f for f in (diagram_repair, diagram_repair_current, diagram_kinds)}


def quoted(text: str) -> str:
    return "E'" + text.replace("'", "''").replace("\n", "\\n") + "'"


OWN = "replace(text, 'flowchart TD' || chr(10) || 'A[step one]', 'flowchart TD' || chr(10) || 'A[\"step one\"]')"


def _twin(text: int, fixes: int) -> str:
    rows = ", ".join(f"({k}, {quoted(p[text])}, {p[fixes]})" for k, p in enumerate(PLANTED))
    return f"""WITH {VDOCS}, d(k, t, n) AS (VALUES {rows}),
        b AS (SELECT conv_id, text, CASE WHEN conv_id % 2 = 0 THEN answers ELSE 0 END::BIGINT AS own FROM vdocs),
        m AS (SELECT conv_id, own, x.n AS xn, y.n AS yn, CASE WHEN own > 0 THEN {OWN} ELSE text END || E'\\n```mermaid\\n' || replace(x.t, '@N@', conv_id::VARCHAR) || E'```\\n\\nThe next shows it, too.\\n\\n```mermaid\\n' || replace(y.t, '@N@', conv_id::VARCHAR) || E'```\\n' AS text
          FROM b JOIN d x ON x.k = conv_id % {len(PLANTED)} JOIN d y ON y.k = conv_id // {len(PLANTED)} % {len(PLANTED)})
        SELECT conv_id, own + 2 AS blocks, own + (xn > 0)::INT + (yn > 0)::INT AS changed, own + xn + yn AS fixes, sha256(text) AS text_sha256 FROM m"""


ORACLE_SQL = {
    "diagram_repair": _twin(1, 2),
    "diagram_repair_current": _twin(3, 4),
    "diagram_kinds": f"""WITH {VDOCS}, d(k, kind, n) AS (VALUES {", ".join(f"({k}, '{kind}', {PLANTED[k][0].count(chr(10))})" for k, kind in enumerate(KINDS))}),
        b AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN answers ELSE 0 END::INT AS own FROM vdocs)
        SELECT conv_id, 'c' || conv_id || ':' || i AS block_id, 'flowchart' AS diagram_type, 2 AS lines FROM (SELECT conv_id, unnest(range(own)) AS i FROM b)
        UNION ALL SELECT conv_id, 'c' || conv_id || ':' || own, kind, n FROM b JOIN d ON k = conv_id % {len(PLANTED)}
        UNION ALL SELECT conv_id, 'c' || conv_id || ':' || (own + 1), kind, n FROM b JOIN d ON k = conv_id // {len(PLANTED)} % {len(PLANTED)}""",
}
