"""DuckDB forms of the registered queries, written apart from the engine: windowed joins and recursive CTEs."""

from __future__ import annotations

from codeweave.plans import binding, shapes

_RAW = {
    "sym": binding.SYM.format(part="part"),
    "imp": binding.IMP.format(sym="sym"),
    "cs": binding.CS.format(sym="sym", lineitem="lineitem"),
    "calls": """
        SELECT src, cid AS dst, conf AS confidence, line FROM (
            SELECT *, CASE WHEN n = 1 OR sf = 1 THEN 'EXTRACTED' WHEN im = 1 THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS conf FROM (
                SELECT cs.src, cs.line, s.id AS cid, s.path = a.path AS here, i.dst_path IS NOT NULL AS there, count(*) OVER w AS n,
                    count(*) FILTER (s.path = a.path) OVER w AS sf, count(*) FILTER (i.dst_path IS NOT NULL) OVER w AS im,
                    row_number() OVER (PARTITION BY cs.src, cs.name ORDER BY s.id) AS rn
                FROM cs JOIN sym a ON a.id = cs.src JOIN sym s ON s.name = cs.name LEFT JOIN imp i ON i.src_path = a.path AND i.dst_path = s.path
                WINDOW w AS (PARTITION BY cs.src, cs.name)))
        WHERE n = 1 OR (sf = 1 AND here) OR (sf <> 1 AND im = 1 AND there) OR (n > 1 AND sf <> 1 AND im <> 1 AND rn <= 5)
    """,
    "inh": """
        SELECT src, cid AS dst, CASE WHEN n = 1 OR sf = 1 THEN 'EXTRACTED' ELSE 'AMBIGUOUS' END AS confidence FROM (
            SELECT r.src, s.id AS cid, s.path = a.path AS here, count(*) OVER w AS n, count(*) FILTER (s.path = a.path) OVER w AS sf,
                row_number() OVER (PARTITION BY r.src, r.name ORDER BY s.id) AS rn
            FROM (SELECT DISTINCT * FROM ({raw})) r JOIN sym a ON a.id = r.src
            JOIN sym s ON s.name = r.name AND s.kind IN ('class', 'interface', 'trait', 'enum', 'struct', 'type') WINDOW w AS (PARTITION BY r.src, r.name))
        WHERE n = 1 OR (sf = 1 AND here) OR (n > 1 AND sf <> 1 AND rn <= 5)
    """,
}
_RAW["use"] = f"SELECT * FROM ({_RAW['inh'].format(raw=binding.USE_RAW.format(sym='sym'))}) WHERE src <> dst"
_RAW["inh"] = _RAW["inh"].format(raw=binding.INH_RAW.format(sym="sym"))
_RAW["held"] = """
    SELECT item, holder FROM (SELECT i.id AS item, s.id AS holder, row_number() OVER (PARTITION BY i.id ORDER BY s.end_byte - s.start_byte, s.id) AS r
    FROM sym i JOIN sym s ON s.path = i.path AND s.start_byte <= i.start_byte AND i.start_byte < s.end_byte AND s.id <> i.id) WHERE r = 1
"""
_NEEDS = {"imp": ["sym"], "cs": ["sym"], "calls": ["sym", "imp", "cs"], "inh": ["sym"], "use": ["sym"], "held": ["sym"], "sym": []}


def _with(names: str, body: str, recursive: bool = False) -> str:
    order: list[str] = []
    for n in names.split():
        for x in [*_NEEDS[n], n]:
            if x not in order:
                order.append(x)
    ctes = ", ".join(f"{n} AS MATERIALIZED ({_RAW[n]})" for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes} {body}" if ctes else body


def with_edges(body: str) -> str:
    """``body`` after the CTEs of the bound graph: sym, calls, use and inh."""
    return _with("calls use inh", body)


AT = "path || ':' || line_start"
SPAN = "path || ':' || line_start || '-' || line_end"
KEY3 = "(SELECT name FROM sym WHERE pk = 3)"
PATH3 = "(SELECT path FROM sym WHERE pk = 3)"


def _hop(edge: str, near: str, name: str, columns: str) -> str:
    far = "src" if near == "dst" else "dst"
    return f"SELECT DISTINCT {columns} FROM sym n JOIN {edge} e ON e.{near} = n.id JOIN sym f ON f.id = e.{far} WHERE n.name = '{name}'"


def _reach(edge: str, near: str, name: str | None, depth: int, columns: str) -> str:
    """From the symbols of a name; None: the first name by alphabet that has such an edge."""
    far = "src" if near == "dst" else "dst"
    wanted = f"'{name}'" if name else f"(SELECT min(name) FROM sym WHERE id IN (SELECT {near} FROM {edge}))"
    return f""", w(id, hop) AS (SELECT id, 0 FROM sym WHERE name = {wanted} UNION SELECT e.{far}, hop + 1 FROM w JOIN {edge} e ON e.{near} = w.id WHERE hop < {depth})
        SELECT DISTINCT {columns} FROM sym WHERE id IN (SELECT id FROM w WHERE hop > 0)"""


def _hot(edge: str) -> str:
    return f"""SELECT name, kind, {AT} AS location, count(*) AS in_degree FROM {edge} e JOIN sym s ON s.id = e.dst
        GROUP BY name, kind, path, line_start ORDER BY in_degree DESC, path, line_start, name LIMIT 10"""


def _violations(edge: str) -> str:
    return f"""SELECT DISTINCT a.name || ' (' || a.path || ')' AS "from", b.name || ' (' || b.path || ')' AS "to" FROM {edge} e
        JOIN sym a ON a.id = e.src JOIN sym b ON b.id = e.dst WHERE starts_with(a.path, 'economy/') AND starts_with(b.path, 'small/')"""


def _pagerank(tail: str) -> str:
    steps = [
        "edge AS MATERIALIZED (SELECT src, dst FROM calls UNION ALL SELECT src, dst FROM use UNION ALL SELECT src, dst FROM inh)",
        "deg AS MATERIALIZED (SELECT src, count(*) AS d FROM edge GROUP BY src)",
        "n AS MATERIALIZED (SELECT count(*) AS n FROM sym)",
        "r0 AS MATERIALIZED (SELECT id, 1e0 / n AS r FROM sym, n)",
    ]
    for i in range(20):
        steps.append(
            f"""r{i + 1} AS MATERIALIZED (SELECT s.id, 0.15e0 / n.n + 0.85e0 * (coalesce(g.got, 0e0) + loose.mass / n.n) AS r FROM sym s CROSS JOIN n
            CROSS JOIN (SELECT coalesce(sum(r), 0e0) AS mass FROM r{i} WHERE id NOT IN (SELECT src FROM deg)) loose
            LEFT JOIN (SELECT e.dst AS id, sum(r{i}.r / deg.d) AS got FROM edge e JOIN r{i} ON r{i}.id = e.src JOIN deg ON deg.src = e.src GROUP BY e.dst) g ON g.id = s.id)"""
        )
    return _with("calls use inh", ", " + ", ".join(steps) + " " + tail)


def _path(target: int) -> str:
    """Levels by breadth-first search, then the smallest predecessor from level to level."""
    pick = ", ".join(
        f"s{i} AS (SELECT p.pos, coalesce(l.parent, p.id) AS id, l.parent IS NULL AS done FROM (SELECT {i} AS pos, id FROM s{i - 1} WHERE NOT done) p "
        f"LEFT JOIN par l ON l.id = p.id AND l.hop = (SELECT hop FROM goal) - {i - 1})"
        for i in range(1, 7)
    )
    return _with(
        "calls",
        f""", w(id, hop) AS (SELECT id, 0 FROM sym WHERE name = {KEY3} UNION SELECT e.dst, hop + 1 FROM w JOIN calls e ON e.src = w.id WHERE hop < 6),
        lev AS (SELECT id, min(hop) AS hop FROM w WHERE hop > 0 GROUP BY id),
        ends AS (SELECT id, hop FROM lev WHERE id IN (SELECT id FROM sym WHERE name = (SELECT name FROM sym WHERE pk = {target}))),
        goal AS (SELECT id, hop FROM ends ORDER BY hop, id LIMIT 1),
        par AS (SELECT l.id, l.hop, min(e.src) AS parent FROM lev l JOIN calls e ON e.dst = l.id
            WHERE (l.hop = 1 AND e.src IN (SELECT id FROM sym WHERE name = {KEY3})) OR e.src IN (SELECT p.id FROM lev p WHERE p.hop = l.hop - 1) GROUP BY l.id, l.hop),
        s0 AS (SELECT 0 AS pos, id, false AS done FROM goal), {pick},
        way AS ({" UNION ALL ".join(f"SELECT pos, id FROM s{i} WHERE NOT done" for i in range(7))})
        SELECT CAST((SELECT max(pos) FROM way) - pos AS INTEGER) AS ord, name FROM way JOIN sym USING (id)""",
        True,
    )


_SUB_SECTIONS = f"""
    , focal AS (SELECT * FROM sym WHERE name IN ('blue_bolt', {KEY3})),
    u AS (
        SELECT 'focal' AS section, id FROM focal
        UNION SELECT 'callers', e.src FROM calls e JOIN focal f ON f.id = e.dst UNION SELECT 'callees', e.dst FROM calls e JOIN focal f ON f.id = e.src
        UNION SELECT 'uses', e.dst FROM use e JOIN focal f ON f.id = e.src UNION SELECT 'used_by', e.src FROM use e JOIN focal f ON f.id = e.dst),
    o AS (SELECT section, name, kind, {AT} AS location, row_number() OVER (PARTITION BY section, name ORDER BY path DESC, line_start DESC, id DESC) AS r
        FROM u JOIN sym USING (id) WHERE section = 'focal' OR name NOT IN (SELECT name FROM focal))
    SELECT section, name, kind, location FROM o WHERE r = 1
"""

_OLD = "SELECT 'doc/' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE sha1(text) END AS hash FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT 'doc/' || (-1 - doc_id), sha1(text) FROM documents WHERE doc_id % 50 = 0"
_NEW = "SELECT 'doc/' || doc_id AS path, sha1(text) AS hash FROM documents"

_LANG = "CASE doc_id % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.TS' WHEN 2 THEN '.tsx' WHEN 3 THEN '.go' WHEN 4 THEN '.md' WHEN 5 THEN '.rs' WHEN 6 THEN '' ELSE '.php' END"
_DOC_PATH = f"source || '/' || lang || '/d' || doc_id || {_LANG}"

_SEARCH = "id, name, kind, " + AT + " AS location, signature, visibility, modifiers"

PATH_TARGET = 30

ORACLES: dict[str, str] = {
    "search_symbols": _with("sym", f"SELECT {_SEARCH} FROM sym WHERE contains(lower(name), 'widget') ORDER BY name, id LIMIT 20"),
    "search_symbols_kind": _with("sym", f"SELECT {_SEARCH} FROM sym WHERE contains(lower(name), 'widget') AND kind = 'class' ORDER BY name, id LIMIT 20"),
    "search_symbols_page": _with("sym", f"SELECT {_SEARCH} FROM sym WHERE contains(lower(name), 'widget') ORDER BY name, id LIMIT 20 OFFSET 5"),
    "search_symbols_visibility": _with("sym", f"SELECT {_SEARCH} FROM sym WHERE contains(lower(name), 'widget') AND visibility = 'private' ORDER BY name, id LIMIT 20"),
    "search_symbols_compact": _with("sym", f"SELECT concat_ws(chr(9), name, kind, {AT}, signature) AS \"row\" FROM (SELECT * FROM sym WHERE contains(lower(name), 'widget') ORDER BY name, id LIMIT 20)"),
    "get_symbol": _with("sym", f"SELECT id, name, kind, {SPAN} AS location, signature, doc FROM sym WHERE name = 'blue_bolt' ORDER BY path, id LIMIT 1"),
    "symbols_in_file": _with("sym", f"SELECT id, name, kind, {SPAN} AS location, signature, doc, visibility, modifiers FROM sym WHERE path = {PATH3}"),
    "search_symbols_indexed": _with("sym", f"SELECT {_SEARCH} FROM sym WHERE contains(lower(name), 'widget_')"),
    "search_symbols_indexed_short": _with("sym", f"SELECT {_SEARCH} FROM sym WHERE contains(lower(name), 't_')"),
    "search_docs_indexed": _with("sym", f"SELECT id, name, kind, {AT} AS location, doc FROM sym WHERE doc <> '' AND contains(lower(doc), 'd bolt')"),
    "search_docs": _with("sym", f"SELECT id, name, kind, {AT} AS location, doc FROM sym WHERE doc <> '' AND contains(lower(doc), 'bolt') ORDER BY name, id LIMIT 20"),
    "list_files": _with("sym", "SELECT DISTINCT path FROM sym WHERE starts_with(path, 'economy')"),
    "module_overview": _with(
        "sym",
        """SELECT module, kind, n, files FROM (SELECT split_part(path, '/', 1) AS module, kind, count(*) AS n FROM sym GROUP BY 1, 2)
        JOIN (SELECT split_part(path, '/', 1) AS module, count(DISTINCT path) AS files FROM sym GROUP BY 1) USING (module)""",
    ),
    "overview_files": _with("sym", "SELECT path, count(*) AS symbols FROM sym GROUP BY path"),
    "stats": _with(
        "calls inh use held",
        """SELECT 'File' AS label, count(DISTINCT path) AS n FROM sym UNION ALL SELECT 'Symbol', count(*) FROM sym UNION ALL SELECT 'DEFINED_IN', count(*) FROM sym
        UNION ALL SELECT 'CONTAINS', count(*) FROM held UNION ALL SELECT 'INHERITS', count(*) FROM inh UNION ALL SELECT 'IMPORTS', count(*) FROM imp
        UNION ALL SELECT 'CALLS', count(*) FROM calls UNION ALL SELECT 'USES', count(*) FROM use""",
    ),
    "callers": _with("calls", _hop("calls", "dst", "blue_bolt", "f.name, f.path || ':' || f.line_start AS location, confidence, line AS call_line")),
    "callees": _with("calls", _hop("calls", "src", "blue_bolt", "f.name, f.path || ':' || f.line_start AS location, confidence, line AS call_line")),
    "callers_compact": _with("calls", _hop("calls", "dst", "blue_bolt", "concat_ws(chr(9), f.name, f.path || ':' || f.line_start, confidence, '@' || line) AS \"row\"")),
    "uses": _with("use", f"SELECT DISTINCT f.name, f.kind, f.path || ':' || f.line_start AS location, confidence FROM sym n JOIN use e ON e.src = n.id JOIN sym f ON f.id = e.dst WHERE n.name = {'(SELECT min(name) FROM sym WHERE id IN (SELECT src FROM use))'}"),
    "used_by": _with("use", "SELECT DISTINCT f.name, f.kind, f.path || ':' || f.line_start AS location, confidence FROM sym n JOIN use e ON e.dst = n.id JOIN sym f ON f.id = e.src WHERE n.name = (SELECT min(name) FROM sym WHERE id IN (SELECT dst FROM use))"),
    "imports": _with("imp", f"SELECT dst_path AS path FROM imp WHERE src_path = {PATH3}"),
    "dependents": _with("imp", f"SELECT src_path AS path FROM imp WHERE dst_path = {PATH3}"),
    "hot_symbols_calls": _with("calls", _hot("calls")),
    "hot_symbols_uses": _with("use", _hot("use")),
    "hot_symbols_inherits": _with("inh", _hot("inh")),
    "arch_violations_imports": _with("imp", "SELECT src_path AS \"from\", dst_path AS \"to\" FROM imp WHERE starts_with(src_path, 'economy/') AND starts_with(dst_path, 'small/')"),
    "arch_violations_calls": _with("calls", _violations("calls")),
    "arch_violations_uses": _with("use", _violations("use")),
    "arch_violations_inherits": _with("inh", _violations("inh")),
    "callers_k": _with("calls", _reach("calls", "dst", "blue_bolt", 2, f"name, {AT} AS location"), True),
    "callees_k": _with("calls", _reach("calls", "src", "blue_bolt", 2, f"name, {AT} AS location"), True),
    "inheritors_k": _with("inh", _reach("inh", "dst", "blue_bolt", 3, f"name, kind, {AT} AS location"), True),
    "inherited_from_k": _with("inh", _reach("inh", "src", None, 3, f"name, kind, {AT} AS location"), True),
    "shortest_path": _path(PATH_TARGET),
    "subgraph": _with("calls use", _SUB_SECTIONS),
    "resolve_imports": r"""
        WITH f AS (SELECT DISTINCT path FROM (SELECT source || '/' || lang || '/d' || (doc_id % 97) || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.ts' END AS path, doc_id FROM documents)),
        raw AS (SELECT DISTINCT source || '/' || lang || '/d' || (doc_id % 97) || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.ts' END AS src_path,
            CASE doc_id % 5 WHEN 0 THEN './d' || (doc_id * 7 % 97) WHEN 1 THEN '../' || lang || '/d' || (doc_id * 3 % 97)
                WHEN 2 THEN source || '.d' || (doc_id * 5 % 97) WHEN 3 THEN source || '/' || lang || '/d' || (doc_id * 11 % 97) ELSE 'missing.mod' || doc_id END AS raw FROM documents),
        pl AS (SELECT regexp_replace(path, '\.[^./]*$', '') AS place, min(path) AS at_place FROM f GROUP BY 1),
        st AS (SELECT regexp_replace(split_part(path, '/', -1), '\.[^./]*$', '') AS stem, min(path) AS of_stem FROM f GROUP BY 1 HAVING count(*) = 1),
        r AS (SELECT src_path, raw, starts_with(raw, '.') AS rel,
            CASE WHEN starts_with(raw, './') THEN regexp_replace(src_path, '/[^/]*$', '') || '/' || substr(raw, 3)
                WHEN starts_with(raw, '../') THEN regexp_replace(regexp_replace(src_path, '/[^/]*$', ''), '/[^/]*$', '') || '/' || substr(raw, 4) ELSE raw END AS place,
            CASE WHEN starts_with(raw, '.') THEN split_part(raw, '/', -1) ELSE regexp_extract(raw, '([^./\\]*)$', 1) END AS stem FROM raw)
        SELECT DISTINCT src_path, CASE WHEN rel THEN coalesce(at_place, of_stem) ELSE coalesce(of_stem, at_place) END AS dst_path
        FROM r LEFT JOIN pl USING (place) LEFT JOIN st USING (stem)
        WHERE CASE WHEN rel THEN coalesce(at_place, of_stem) ELSE coalesce(of_stem, at_place) END <> src_path
    """,
    "resolve_calls": _with("calls", "SELECT src, dst, confidence, line FROM calls"),
    "resolve_inherits": _with("inh", "SELECT src, dst, confidence FROM inh"),
    "resolve_uses": _with("use", "SELECT src, dst, confidence FROM use"),
    "contains": _with("held", "SELECT holder AS src, item AS dst FROM held"),
    "enclosing_symbol": _with(
        "sym",
        """SELECT item, holder FROM (SELECT i.id AS item, s.id AS holder, row_number() OVER (PARTITION BY i.id ORDER BY s.end_byte - s.start_byte, s.id) AS r
        FROM sym i JOIN sym s ON s.path = i.path AND s.start_byte <= i.start_byte + 2 AND i.start_byte + 2 < s.end_byte) WHERE r = 1""",
    ),
    "enclosing_type": _with(
        "sym",
        """SELECT item, holder FROM (SELECT i.id AS item, s.id AS holder, row_number() OVER (PARTITION BY i.id ORDER BY s.end_byte - s.start_byte, s.id) AS r
        FROM sym i JOIN sym s ON s.path = i.path AND s.start_byte <= i.start_byte + 2 AND i.start_byte + 2 < s.end_byte
        AND s.kind IN ('class', 'interface', 'trait', 'enum', 'struct')) WHERE r = 1""",
    ),
    "pagerank": _pagerank("SELECT id, round(r, 8) AS rank FROM r20"),
    "repo_map": _pagerank(
        f""", m AS (SELECT id, round(r, 8) AS rank, printf('%.4f', r) || chr(9) || kind || chr(9) || {AT} || chr(9) || substr(signature, 1, 160) AS "row" FROM r20 JOIN sym USING (id)
            WHERE kind IN ('function', 'method', 'class', 'interface', 'struct', 'enum', 'trait') ORDER BY round(r, 8) DESC, id LIMIT 500),
        c AS (SELECT *, sum(length("row") // 4) OVER (ORDER BY rank DESC, id ROWS UNBOUNDED PRECEDING) AS spent FROM m)
        SELECT id, rank FROM c WHERE spent <= 2000"""
    ),
    "manifest_diff": f"""
        SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.hash = n.hash THEN 'same' ELSE 'changed' END AS status
        FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.path = n.path
    """,
    "extract_cache_miss": f"""
        SELECT n.path, n.hash, sha1('v1:' || n.path || '@' || n.hash) AS cache_key FROM ({_NEW}) n
        WHERE NOT EXISTS (SELECT 1 FROM ({_OLD}) o WHERE o.path = n.path AND o.hash = n.hash)
    """,
    "upsert_merge": f"SELECT path, hash FROM ({_NEW}) UNION ALL SELECT path, hash FROM ({_OLD}) WHERE path NOT IN (SELECT path FROM ({_NEW}))",
    "delete_file": _with(
        "calls inh use held",
        f"""SELECT label, n FROM (SELECT 'symbols' AS label, count(*) AS n FROM sym WHERE path <> {PATH3}
        UNION ALL SELECT 'calls', count(*) FROM calls WHERE src NOT IN (SELECT id FROM sym WHERE path = {PATH3}) AND dst NOT IN (SELECT id FROM sym WHERE path = {PATH3})
        UNION ALL SELECT 'uses', count(*) FROM use WHERE src NOT IN (SELECT id FROM sym WHERE path = {PATH3}) AND dst NOT IN (SELECT id FROM sym WHERE path = {PATH3})
        UNION ALL SELECT 'inherits', count(*) FROM inh WHERE src NOT IN (SELECT id FROM sym WHERE path = {PATH3}) AND dst NOT IN (SELECT id FROM sym WHERE path = {PATH3})
        UNION ALL SELECT 'contains', count(*) FROM held WHERE item NOT IN (SELECT id FROM sym WHERE path = {PATH3}) AND holder NOT IN (SELECT id FROM sym WHERE path = {PATH3})
        UNION ALL SELECT 'imports', count(*) FROM imp WHERE src_path <> {PATH3} AND dst_path <> {PATH3})""",
    ),
    "edge_integrity": _with("sym", "SELECT src, dst FROM (SELECT id AS src, path || '#' || (pk + 150) AS dst FROM sym) WHERE dst IN (SELECT id FROM sym)"),
    "content_hash": "SELECT page_id, sha1(html) AS hash FROM pages",
    "detect_language": f"""
        SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'tsx' WHEN 3 THEN 'go' WHEN 5 THEN 'rust' WHEN 7 THEN 'php' END AS lang
        FROM (SELECT doc_id, {_DOC_PATH} AS p FROM documents)
    """,
    "scan_filter": f"""
        SELECT path FROM (SELECT CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'node_modules/' WHEN 2 THEN '.hidden/' WHEN 3 THEN 'src/' WHEN 4 THEN 'build/' ELSE 'a/b/' END || {_DOC_PATH} AS path,
            doc_id FROM documents) WHERE doc_id % 6 IN (0, 3, 5) AND doc_id % 8 NOT IN (4, 6)
    """,
    "read_body": "SELECT page_id, substr(html, CAST(page_id % 400 AS INTEGER) + 1, 900) AS body FROM pages",
    "batch_bodies": _with(
        "sym",
        f"""SELECT CAST(o AS INTEGER) AS ord, ref, CASE WHEN s.id IS NULL THEN NULL ELSE {SPAN} END AS location, s.kind,
            substr(rpad(s.path, CAST((SELECT max(end_byte) FROM sym t WHERE t.path = s.path) AS INTEGER), s.path || ';'), s.start_byte + 1, s.end_byte - s.start_byte) AS body,
            CASE WHEN s.id IS NULL THEN 'not found' END AS error
        FROM (SELECT 0 AS o, 'blue_bolt' AS ref UNION ALL SELECT 1, 'no such symbol' UNION ALL SELECT 2, (SELECT id FROM sym WHERE pk = 7)) q
        LEFT JOIN LATERAL (SELECT * FROM sym WHERE id = q.ref OR name = q.ref ORDER BY id <> q.ref, path, id LIMIT 1) s ON true""",
    ),
    "hot_symbols_invalid_edge": "SELECT '' AS name, '' AS kind, '' AS location, CAST(0 AS BIGINT) AS in_degree WHERE false",
    "arch_violations_invalid_edge": "SELECT '' AS \"from\", '' AS \"to\" WHERE false",
    "cypher_callers": _with("calls", _hop("calls", "dst", "blue_bolt", "f.name, confidence, line")),
    "cypher_kinds": _with("sym", "SELECT kind, count(*) AS n FROM sym WHERE visibility <> 'private' AND NOT ends_with(name, '0') GROUP BY kind"),
    "cypher_reach": _with(
        "inh use",
        """, e AS (SELECT src, dst FROM inh UNION SELECT src, dst FROM use), o AS (SELECT dst AS id FROM e WHERE src IN (SELECT id FROM sym WHERE name = 'blue_bolt'))
        SELECT id FROM o UNION SELECT dst FROM e WHERE src IN (SELECT id FROM o)""",
    ),
    "cypher_shortest": _with(
        "calls",
        """, w(id, hop) AS (SELECT id, 0 FROM sym WHERE pk = 3 UNION SELECT e.dst, hop + 1 FROM w JOIN calls e ON e.src = w.id WHERE hop < 3)
        SELECT id, CAST(min(hop) - 1 AS INTEGER) AS between FROM w WHERE hop > 0 GROUP BY id""",
        True,
    ),
    "cypher_files": _with("sym", "SELECT path, count(*) AS n FROM sym WHERE starts_with(path, 'economy') GROUP BY path"),
    **{
        name: _with(
            "sym",
            f"""SELECT {columns} FROM (
                SELECT *, sum(strlen(a) + strlen(b) + strlen(c) + strlen(d)) OVER w - strlen(a) - strlen(b) - strlen(c) - strlen(d) AS ofs, (row_number() OVER w - 1) * 5 AS before FROM (
                    SELECT path, pk, '# part ' || pk || chr(10) AS a, 'class C' || pk || '(B' || pk % 7 || '):' || chr(10) AS b,
                        '    def m' || pk || '(self, x: T' || pk % 5 || '):' || chr(10) AS c, '        return self.m' || (pk * 7 + 3) % 1000 || '(x)' || chr(10) || chr(10) AS d FROM sym)
                WINDOW w AS (PARTITION BY path ORDER BY pk)) {tail}""",
        )
        for name, columns, tail in (
            (
                "extract_symbols",
                """path, CASE k WHEN 0 THEN 'C' ELSE 'm' END || pk AS name, CASE k WHEN 0 THEN 'class' ELSE 'function' END AS kind, CAST(before + 2 + k AS BIGINT) AS line_start,
                CAST(before + 4 AS BIGINT) AS line_end, CAST(ofs + strlen(a) + k * (strlen(b) + 4) AS BIGINT) AS start_byte, CAST(ofs + strlen(a) + strlen(b) + strlen(c) + strlen(d) - 2 AS BIGINT) AS end_byte,
                CASE k WHEN 0 THEN rtrim(b, chr(10)) ELSE trim(rtrim(c, chr(10))) END AS signature, CASE k WHEN 0 THEN rtrim(a, chr(10)) ELSE '' END AS doc""",
                "CROSS JOIN (SELECT unnest([0, 1]) AS k)",
            ),
            ("extract_calls", "path, 'm' || (pk * 7 + 3) % 1000 AS callee_name, CAST(before + 4 AS BIGINT) AS line", ""),
            ("extract_bases_and_uses", "path, CASE k WHEN 0 THEN 'base' ELSE 'use' END AS what, CASE k WHEN 0 THEN 'B' || pk % 7 ELSE 'T' || pk % 5 END AS name", "CROSS JOIN (SELECT unnest([0, 1]) AS k)"),
            ("extract_contains", "path, CAST(count(*) AS INTEGER) AS n, 'python' AS lang", "GROUP BY path"),
        )
    },
    **{f"extract_{lang}": _with("sym", shapes.expected(shape)) for lang, shape in shapes.SHAPES.items()},
    "project_slug": "SELECT page_id, CASE WHEN b = '' THEN 'repo' ELSE b END || '-' || substr(sha1(url), 1, 10) AS slug FROM (SELECT page_id, url, regexp_replace(split_part(url, '/', -1), '[^A-Za-z0-9_.-]', '-', 'g') AS b FROM pages)",
    "registry_upsert": """WITH n AS (SELECT CASE WHEN page_id % 3 = 0 THEN url || '/moved' ELSE url END AS root FROM pages)
        SELECT root, 2 AS version FROM n UNION ALL SELECT url, 1 FROM pages WHERE url NOT IN (SELECT root FROM n)""",
    "search_semantic": """
        WITH q AS (SELECT list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v FROM embeddings WHERE vec_id = 0),
        s AS (SELECT vec_id, list_dot_product(list_transform(embedding, lambda e: CAST(e AS DOUBLE)), q.v)
            / sqrt(list_dot_product(list_transform(embedding, lambda e: CAST(e AS DOUBLE)), list_transform(embedding, lambda e: CAST(e AS DOUBLE)))) / sqrt(list_dot_product(q.v, q.v)) AS x FROM embeddings, q)
        SELECT CAST(vec_id AS VARCHAR) AS id, round(x, 6) AS score FROM s ORDER BY x DESC, CAST(vec_id AS VARCHAR) LIMIT 15
    """,
    "latent_matrix": """
        WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(regexp_replace(text, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^\\P{L}A-Za-z]+'), lambda x: lower(x)) AS w FROM documents),
        t AS (SELECT doc_id, list_concat(w, list_transform(list_filter(w, lambda x: length(x) > 4), lambda x: substr(x, 1, 4) || '*')) AS t FROM w),
        c AS (SELECT doc_id, token, total, count(*) AS n FROM (SELECT doc_id, len(t) AS total, unnest(t) AS token FROM t) GROUP BY ALL),
        s AS (SELECT token, sum(n) / (SELECT sum(n) FROM c) AS share FROM c GROUP BY token HAVING count(*) >= 2)
        SELECT doc_id, token, round(ln(n / (total * share)), 6) AS x FROM c JOIN s USING (token) WHERE ln(n / (total * share)) > 0
    """,
    "watch_relevant": f"""
        SELECT path FROM (SELECT CASE doc_id % 6 WHEN 0 THEN '/w/' WHEN 1 THEN '/w/node_modules/' WHEN 2 THEN '/w/.hidden/' WHEN 3 THEN '/w/src/' WHEN 4 THEN '/other/' ELSE '/w/a/b/' END || {_DOC_PATH} AS path,
            doc_id FROM documents) WHERE doc_id % 6 IN (0, 3, 5) AND doc_id % 8 NOT IN (4, 6)
    """,
    **{
        f"watch_debounce{suffix}": f"""
        WITH e AS (SELECT ts, event_type = 'purchase' AS is_head FROM events),
        g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) <= INTERVAL '{gap}' THEN 0 ELSE 1 END AS fresh FROM e),
        s AS (SELECT *, sum(fresh) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT min(ts) AS first_event, max(ts) AS last_event, count(*) AS n_events, CASE WHEN bool_or(is_head) THEN 'branch switched' ELSE 'files changed' END AS reason FROM s GROUP BY k
        """
        for suffix, gap in (("", "10 minutes"), ("_short", "1500 milliseconds"))
    },
}
