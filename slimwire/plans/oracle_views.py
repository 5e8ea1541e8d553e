"""DuckDB text of the derived views, used to build the oracle SQL of each query.

Each constant is one ``name AS (...)`` CTE item; :func:`with_views` assembles the
ones a query needs (dependencies first). They mirror ``slimwire.sources.tables``.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {}
DEPS: dict[str, list[str]] = {}


def _view(name: str, sql: str, deps: list[str] | None = None) -> None:
    VIEWS[name] = f"{name} AS ({sql})"
    DEPS[name] = deps or []


_view("requests", """
  SELECT conv_id*1000000+turn AS request_id, concat('s', CAST(conv_id AS VARCHAR)) AS session_id,
         conv_id*1000000+turn*10 AS at_ms,
         CASE WHEN conv_id%2=0 THEN 'anthropic' ELSE 'openai' END AS provider,
         concat('model_', CAST(conv_id%4 AS VARCHAR)) AS model, conv_id, turn
  FROM conversations WHERE role='user'""")

_view("request_blocks", """
  SELECT r.request_id, r.session_id, r.at_ms, r.provider, r.model,
         CASE WHEN m.role='system' AND r.provider='anthropic' THEN 'system' ELSE 'message' END AS section,
         m.turn AS msg_idx, CAST(0 AS BIGINT) AS block_idx, m.role, m.text
  FROM requests r JOIN conversations m ON m.conv_id=r.conv_id AND m.turn<=r.turn""", ["requests"])

_view("dup_blocks", """
  SELECT doc_id//5000*97+n_chars%97 AS request_id, concat('b', CAST(doc_id//5000*97+n_chars%97 AS VARCHAR)) AS session_id,
         doc_id//5000*97+n_chars%97 AS at_ms, 'openai' AS provider, 'model_0' AS model, 'message' AS section,
         doc_id AS msg_idx, CAST(0 AS BIGINT) AS block_idx, 'user' AS role, text
  FROM documents""")

_view("line_blocks", """
  SELECT doc_id AS request_id, concat('d', CAST(doc_id AS VARCHAR)) AS session_id, doc_id AS at_ms,
         'openai' AS provider, 'model_0' AS model, 'message' AS section, CAST(0 AS BIGINT) AS msg_idx,
         CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS block_idx, 'user' AS role, unnest(l) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")

_view("system_blocks", """
  SELECT doc_id AS request_id, concat('y', CAST(doc_id AS VARCHAR)) AS session_id, doc_id AS at_ms,
         'anthropic' AS provider, 'model_1' AS model, 'system' AS section, CAST(0 AS BIGINT) AS msg_idx,
         CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS block_idx, 'system' AS role, unnest(l) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")

_view("noisy_docs", """
  SELECT doc_id, replace(text, '. ', concat('.  ', chr(10), chr(10), chr(10), chr(10))) AS text
  FROM documents""")

_view("noisy_blocks", """
  SELECT doc_id AS request_id, concat('n', CAST(doc_id AS VARCHAR)) AS session_id, doc_id AS at_ms,
         'openai' AS provider, 'model_0' AS model, 'message' AS section, CAST(0 AS BIGINT) AS msg_idx,
         CAST(0 AS BIGINT) AS block_idx, 'user' AS role, text
  FROM noisy_docs""", ["noisy_docs"])

_view("file_versions", """
  SELECT r.session_id, r.at_ms, r.request_id,
         concat('src/conv_', substr(r.session_id, 2), '.txt') AS path,
         concat('src/conv_', substr(r.session_id, 2), '.txt', chr(10), 'rev ',
                CAST(r.request_id%1000000 AS VARCHAR), chr(10), a.body) AS text
  FROM requests r JOIN (SELECT request_id, string_agg(text, chr(10) ORDER BY msg_idx) AS body
                        FROM request_blocks GROUP BY request_id) a ON a.request_id=r.request_id""",
      ["requests", "request_blocks"])

_view("file_revisions", """
  SELECT r.request_id, r.session_id, r.at_ms, concat('src/conv_', CAST(r.conv_id AS VARCHAR), '.txt') AS path,
         concat('src/conv_', CAST(r.conv_id AS VARCHAR), '.txt', chr(10), 'rev ', CAST(r.turn AS VARCHAR), chr(10),
                c.body) AS text
  FROM requests r JOIN (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS body
                        FROM conversations GROUP BY conv_id) c ON c.conv_id = r.conv_id""", ["requests"])

_view("all_blocks", """
  SELECT request_id, session_id, at_ms, provider, model, section, msg_idx, block_idx, role, text FROM request_blocks
  UNION ALL SELECT request_id, session_id, at_ms, provider, model, section, msg_idx, block_idx, role, text FROM dup_blocks
  UNION ALL SELECT request_id, session_id, at_ms, provider, model, section, msg_idx, block_idx, role, text FROM noisy_blocks
  UNION ALL SELECT request_id, session_id, at_ms, provider, model, section, msg_idx, block_idx, role, text FROM system_blocks
  UNION ALL SELECT request_id, session_id, at_ms, provider, model, section, msg_idx, block_idx, role, text FROM line_blocks""",
      ["request_blocks", "dup_blocks", "noisy_blocks", "system_blocks", "line_blocks"])

_view("request_metrics", """
  SELECT event_id AS id, event_id*1000 AS at_ms,
         CASE WHEN user_id%2=0 THEN 'anthropic' ELSE 'openai' END AS provider, event_type AS model,
         concat('u', CAST(user_id AS VARCHAR)) AS session_id, 100+event_id%900 AS tokens_before,
         100+event_id%900-(event_id%97-5) AS tokens_after, event_id%97-5 AS saved,
         value AS duration_ms
  FROM events""")

_view("context_puts", """
  SELECT ln AS content, CASE WHEN pos%3=0 THEN source ELSE '' END AS label,
         doc_id*100000000+pos AS at_ms, concat('d', CAST(doc_id%20 AS VARCHAR)) AS session_id
  FROM (SELECT doc_id, source, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS pos, unnest(l) AS ln
        FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents))
  WHERE ln <> ''""")

# Regex pieces shared by oracle queries (RE2 syntax).
RE_TRAILING = r"[ \t]+(\n|\z)"
RE_BLANK = r"^[\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]*$"


def clean_sql(expr: str) -> str:
    return (f"regexp_replace(regexp_replace({expr}, '{RE_TRAILING}', '\\1', 'g'), "
            f"'\\n{{3,}}', concat(chr(10), chr(10)), 'g')")


def tok_sql(expr: str) -> str:
    return f"CAST(CASE WHEN length({expr})=0 THEN 0 ELSE ceil(length({expr})/4.0) END AS BIGINT)"


def with_views(*names: str) -> str:
    """``WITH`` clause holding the named views and their dependencies, in order."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        for d in DEPS[n]:
            visit(d)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(VIEWS[n] for n in ordered)
