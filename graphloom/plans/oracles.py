"""SQL for DuckDB that must return the rows of the registered queries."""

from __future__ import annotations

_NATION = """
buys AS (
  SELECT c.c_nationkey::BIGINT AS source_key, c.c_mktsegment, l.* FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
), packages AS (
  SELECT DISTINCT source_key AS key, p_brand AS package FROM buys JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 49 AND l_discount <= 0.01
), nodes AS (
  SELECT n_nationkey::BIGINT AS key, n_name AS name, r_name AS group_path,
    CASE WHEN n_nationkey % 7 = 0 OR n_nationkey % 11 = 2 OR lower(n_name) LIKE '%.tests%' OR lower(n_name) LIKE '%tests' OR lower(n_name) LIKE '%test' THEN 'test'
         WHEN n_name LIKE 'I%' THEN 'web' WHEN n_nationkey % 5 = 1 THEN 'desktop' WHEN n_nationkey % 3 = 1 THEN 'app' ELSE 'library' END AS kind,
    coalesce((SELECT count(*) FROM packages p WHERE p.key = n_nationkey), 0)::INTEGER AS package_references
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey <> 4
), refs AS (
  SELECT source_key, s_nationkey::BIGINT AS target_key, l_returnflag = 'R' AS is_conditional
  FROM buys JOIN supplier ON l_suppkey = s_suppkey WHERE source_key IN (SELECT key FROM nodes)
), edges AS (
  SELECT source_key, target_key, count(*) AS count FROM refs WHERE target_key IN (SELECT key FROM nodes) GROUP BY ALL
), named AS (
  SELECT e.source_key, e.target_key, s.name AS source_name, t.name AS target_name, e.count
  FROM edges e JOIN nodes s ON e.source_key = s.key JOIN nodes t ON e.target_key = t.key
), degrees AS (
  SELECT n.*, coalesce((SELECT sum(count) FROM edges WHERE source_key = key), 0)::BIGINT AS outgoing,
    coalesce((SELECT sum(count) FROM edges WHERE target_key = key), 0)::BIGINT AS incoming FROM nodes n
), top AS (
  SELECT * FROM degrees ORDER BY outgoing + incoming DESC, package_references DESC, name, key LIMIT 8
)"""

_SUCCESSION = """
pairs AS (
  SELECT user_id AS source_key, lead(user_id) OVER (ORDER BY ts, event_id) AS target_key FROM events
), every AS (
  SELECT source_key, target_key, count(*) AS count FROM pairs WHERE target_key IS NOT NULL GROUP BY ALL
)"""

_NODE = """
  SELECT key, 'user-' || key AS name, CASE WHEN key % 3 = 0 THEN 'web' ELSE 'library' END AS kind, 'team_' || (key % 4) AS group_path,
    CASE WHEN key % 2 = 0 THEN '/src/user' || key || '.cs' END AS representative_file
  FROM (SELECT source_key AS key FROM {0} UNION SELECT target_key FROM {0})"""

_GRAPH = """reach AS (
  SELECT source_key AS a, target_key AS z FROM edges UNION SELECT r.a, e.target_key FROM reach r JOIN edges e ON r.z = e.source_key
), mutual AS (
  SELECT x.a, x.z FROM reach x JOIN reach y ON x.a = y.z AND x.z = y.a
), scc AS (
  SELECT n.key, coalesce(least(n.key, (SELECT min(z) FROM mutual WHERE a = n.key)), n.key) AS scc_id FROM nodes n
), cyclic AS (
  SELECT key, scc_id FROM scc WHERE scc_id IN (
    SELECT scc_id FROM scc GROUP BY scc_id HAVING count(*) > 1 OR bool_or(key IN (SELECT source_key FROM edges WHERE source_key = target_key)))
), cycle_links AS (
  SELECT source_key, target_key FROM edges e JOIN cyclic s ON s.key = source_key JOIN cyclic t ON t.key = target_key WHERE s.scc_id = t.scc_id
), found AS (
  SELECT row_number() OVER (ORDER BY len(nodes) DESC, nodes[1], scc_id) AS rank, '{scope}' AS scope, nodes, len(nodes) AS length, scc_id
  FROM (SELECT scc_id, list(name ORDER BY name) AS nodes FROM cyclic JOIN nodes USING (key) GROUP BY scc_id)
), degrees AS (
  SELECT n.*, coalesce((SELECT sum(count) FROM edges WHERE source_key = key), 0)::BIGINT + coalesce((SELECT sum(count) FROM edges WHERE target_key = key), 0)::BIGINT AS degree FROM nodes n
), top AS (
  SELECT * FROM degrees ORDER BY degree DESC, name, key LIMIT {n}
), drawn AS (
  SELECT row_number() OVER (ORDER BY upper(group_path), name, key) - 1 AS position, dense_rank() OVER (ORDER BY upper(group_path)) - 1 AS group_position,
    key, name, kind, group_path AS group_name, representative_file, key IN (SELECT key FROM cyclic) AS in_cycle FROM top
), shown AS (
  SELECT row_number() OVER (ORDER BY e.count DESC, s.name, t.name, source_key, target_key) - 1 AS place, source_key, target_key, 'P' || s.position AS source_node_id,
    'P' || t.position AS target_node_id, s.name AS source_name, t.name AS target_name, e.count,
    (source_key, target_key) IN (SELECT (source_key, target_key) FROM cycle_links) AS in_cycle
  FROM edges e JOIN drawn s ON s.key = source_key JOIN drawn t ON t.key = target_key QUALIFY place < {m}
)"""

_USERS = (
    _SUCCESSION
    + """, edges AS (
  SELECT source_key, target_key, count FROM (
    SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY count DESC, target_key) AS rn FROM every) WHERE rn = 1
), nodes AS ("""
    + _NODE.format("edges")
    + "), "
    + _GRAPH.format(scope="project", n=20, m=30)
)

_LINES = """, lines AS (
  SELECT 0 AS section, 0 AS a, 0 AS b, 'flowchart LR' AS line
  UNION ALL SELECT 1, group_position, -1, '  subgraph G' || group_position || '["' || min_by(group_name, position) || '"]' FROM drawn GROUP BY group_position
  UNION ALL SELECT 1, group_position, position, '    P' || position || '["' || replace(name, '#', '&#35;') || '\\n' || kind || '"]' FROM drawn
  UNION ALL SELECT 1, group_position, 1073741824, '  end' FROM (SELECT DISTINCT group_position FROM drawn)
  UNION ALL SELECT 2, 0, 0, '  EmptyLink["No dependencies found"]' WHERE (SELECT count(*) FROM shown) = 0
  UNION ALL SELECT 3, place, 0, '  ' || source_node_id || ' E' || place || '@--> ' || target_node_id FROM shown
  UNION ALL SELECT 4, position, 0, '  style P' || position || ' stroke:#e5484d,stroke-width:2px' FROM drawn WHERE in_cycle
  UNION ALL SELECT 5, 0, 0, '  linkStyle ' || string_agg(place::VARCHAR, ',' ORDER BY place) || ' stroke:#e5484d,stroke-width:2px' FROM shown WHERE in_cycle HAVING count(*) > 0
)"""

_ORDERS = """
buys AS (
  SELECT c.c_mktsegment AS project, p.p_brand, p.p_size, l.* FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN part p ON l.l_partkey = p.p_partkey
), declared AS (
  SELECT DISTINCT l_orderkey AS record, project, p_brand AS ns FROM buys WHERE l_linestatus = 'F' AND l_quantity >= 45
), used AS (
  SELECT DISTINCT l_orderkey AS record, p_brand AS target FROM buys WHERE l_linestatus = 'O' AND l_returnflag = 'R' AND l_quantity >= 40
), shared AS (
  SELECT DISTINCT project, p_brand AS target FROM buys WHERE l_discount = 0 AND l_quantity >= 49 AND p_size <= 5
), effective AS (
  SELECT record, target FROM used UNION SELECT d.record, s.target FROM declared d JOIN shared s USING (project)
), edges AS (
  SELECT d.ns AS source_key, e.target AS target_key, count(DISTINCT d.record) AS count FROM declared d JOIN effective e USING (record)
  WHERE e.target IN (SELECT ns FROM declared) AND d.ns <> e.target GROUP BY ALL
), counted AS (
  SELECT ns, project, count(*) AS n FROM declared GROUP BY ALL
), owned AS (
  SELECT ns, project FROM counted QUALIFY row_number() OVER (PARTITION BY ns ORDER BY n DESC, project) = 1
)"""

_TEXT = """
cells AS (
  SELECT rank, unnest(range(0, length)) AS pos, nodes, unnest(nodes) AS name, array_to_string(list_append(nodes, nodes[1]), ' → ') AS cycle FROM found
), anchored AS (
  SELECT CASE WHEN key % 3 = 0 THEN '/abs/p/../' || c.name ELSE '/work/solution/' || c.name END AS file, 0 AS s, rank, pos,
    'Project ''' || c.name || ''' participates in a dependency cycle: ' || cycle AS message FROM cells c JOIN nodes n ON n.name = c.name WHERE key % 4 <> 1
  UNION ALL
  SELECT representative_file, 1, rank, pos, 'Namespace ''' || c.name || ''' participates in a dependency cycle: ' || cycle
  FROM cells c JOIN nodes n ON n.name = c.name WHERE key % 5 <> 2 AND representative_file IS NOT NULL
), loose AS (
  SELECT rank, pos, c.name || ': ' || cycle AS message FROM cells c JOIN nodes n ON n.name = c.name WHERE key % 5 = 2 OR representative_file IS NULL
)"""

_SPACES = (
    _ORDERS
    + """, nodes AS (
  SELECT ns AS key, ns AS name, CASE project WHEN 'AUTOMOBILE' THEN 'app' WHEN 'BUILDING' THEN 'test' WHEN 'FURNITURE' THEN 'library'
    WHEN 'MACHINERY' THEN 'desktop' ELSE 'namespace' END AS kind, project AS group_path,
    'order-' || (SELECT min(record) FROM declared d WHERE d.ns = owned.ns) AS representative_file FROM owned
), """
    + _GRAPH.format(scope="namespace", n=12, m=20)
)

_MESSAGES = """, reach AS (
  SELECT source_key AS a, target_key AS z FROM edges UNION SELECT r.a, e.target_key FROM reach r JOIN edges e ON r.z = e.source_key
), cyclic AS (
  SELECT x.a AS key, min(x.z) AS scc_id FROM reach x JOIN reach y ON x.a = y.z AND x.z = y.a GROUP BY x.a
), k AS (
  SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges) AS m, (SELECT sum(package_references) FROM nodes) AS p,
    (SELECT count(*) FROM refs WHERE target_key NOT IN (SELECT key FROM nodes)) AS e, (SELECT count(*) FROM refs WHERE is_conditional) AS c,
    (SELECT count(DISTINCT scc_id) FROM cyclic) AS g, (SELECT count(*) FROM cyclic) AS i,
    (SELECT least(15, count(*)) FROM named WHERE source_key IN (SELECT key FROM top) AND target_key IN (SELECT key FROM top)) AS s
), said AS (
  SELECT 'notes' AS kind, 1 AS o, 'Diagram truncated to the top 8 projects out of ' || n || ' total.' AS text FROM k WHERE n > 8
  UNION ALL SELECT 'notes', 2, 'Showing the top ' || s || ' project reference edges out of ' || m || ' total.' FROM k WHERE s < m
  UNION ALL SELECT 'notes', 3, 'PackageReference nodes are summarized only: ' || p || ' package reference(s) across ' || n || ' project(s).' FROM k WHERE p > 0
  UNION ALL SELECT 'warnings', 1, e || ' project reference(s) point outside the selected solution and are summarized as externals.' FROM k WHERE e > 0
  UNION ALL SELECT 'warnings', 2, c || ' conditional ProjectReference item(s) were detected and may vary by configuration.' FROM k WHERE c > 0
  UNION ALL SELECT 'warnings', 3, g || ' circular project-dependency group(s) detected involving ' || i || ' project(s).' FROM k WHERE g > 0
)"""

_P = f"WITH RECURSIVE {_SPACES} "
_N, _U, _O = f"WITH {_NATION} ", f"WITH RECURSIVE {_USERS} ", f"WITH {_ORDERS} "
_S = f"WITH {_SUCCESSION}, edges AS (SELECT * FROM every), nodes AS ({_NODE.format('every')}) "


def oracle_sql() -> dict[str, str]:
    scc = _U + "SELECT key, scc_id FROM scc"
    return {
        "project_edges": _N + "SELECT * FROM named",
        "external_conditional_counts": _N
        + "SELECT count(*) FILTER (target_key NOT IN (SELECT key FROM nodes)) AS external_references, count(*) FILTER (is_conditional) AS conditional_references FROM refs",
        "node_degrees": _N + "SELECT key, name, kind, group_path, package_references, outgoing, incoming FROM degrees",
        "dependency_hubs_top6": _N
        + "SELECT key, name, kind, package_references, outgoing, incoming FROM degrees ORDER BY outgoing + incoming DESC, package_references DESC, name, key LIMIT 6",
        "kind_summary": _N + "SELECT kind, count(*) AS count FROM nodes GROUP BY kind",
        "report_totals": _N
        + """SELECT count(*) AS project_count, sum(package_references)::BIGINT AS total_package_references, count(*) FILTER (kind = 'test') AS test_project_count,
             (SELECT sum(count) FROM edges)::BIGINT AS total_dependencies, (SELECT count(*) FROM edges) AS edge_count FROM nodes""",
        "top_nodes": _N + "SELECT key, name, outgoing, incoming, package_references FROM top",
        "visible_edges": _N
        + """SELECT * FROM named WHERE source_key IN (SELECT key FROM top) AND target_key IN (SELECT key FROM top)
             ORDER BY count DESC, source_name, target_name, source_key, target_key LIMIT 15""",
        "packages_distinct_ci": """
            SELECT p_size, min_by(v, p_partkey) AS package FROM (SELECT p_size, p_partkey,
              CASE WHEN p_partkey % 3 = 0 THEN upper(p_brand) WHEN p_partkey % 7 = 0 THEN '  ' ELSE lower(p_brand) END AS v FROM part)
            WHERE trim(v) <> '' GROUP BY p_size, upper(v)""",
        "target_framework_pick": """
            SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_type WHEN p_partkey % 4 = 1 THEN ''
              WHEN p_partkey % 8 <> 2 THEN coalesce(list_filter(string_split(p_name, ' '), lambda x: x <> '')[1], '(not specified)')
              ELSE '(not specified)' END AS framework FROM part""",
        "group_path_recursive": """
            SELECT 'n' || n_nationkey AS child, CASE WHEN r_regionkey % 2 = 0 THEN 'odd/world/even/' ELSE 'world/odd/' END || r_name AS group_path
            FROM nation JOIN region ON n_regionkey = r_regionkey""",
        "scc_components": scc,
        "scc_distributed": scc,
        "cycle_nodes": _U + "SELECT key, scc_id FROM cyclic",
        "cycle_edges": _U + "SELECT * FROM cycle_links",
        "cycles": _U + "SELECT rank::INTEGER AS rank, scope, array_to_string(nodes, ',') AS nodes, length::INTEGER AS length, scc_id FROM found",
        "namespace_edges": _O + "SELECT * FROM edges",
        "namespace_group_kind": _O
        + """SELECT ns AS key, project AS group_path, CASE project WHEN 'AUTOMOBILE' THEN 'app' WHEN 'BUILDING' THEN 'test' WHEN 'FURNITURE' THEN 'library'
             WHEN 'MACHINERY' THEN 'desktop' ELSE 'namespace' END AS kind FROM owned""",
        "representative_file": _O + "SELECT ns, 'order-' || min(record) AS representative_file FROM declared GROUP BY ns",
        "namespace_top_nodes": _O
        + """, d AS (SELECT DISTINCT ns AS key, coalesce((SELECT sum(count) FROM edges WHERE source_key = ns), 0)::BIGINT AS outgoing,
             coalesce((SELECT sum(count) FROM edges WHERE target_key = ns), 0)::BIGINT AS incoming FROM declared)
             SELECT * FROM d ORDER BY outgoing + incoming DESC, key LIMIT 10""",
        "namespace_dependency_count": _O + "SELECT count(*) AS dependency_count, coalesce(sum(count), 0)::BIGINT AS weight FROM edges",
        "diagram_nodes": _U
        + "SELECT 'P' || position AS node_id, key, name, kind, group_name, group_position::INTEGER AS group_position, in_cycle, representative_file FROM drawn",
        "diagram_edges": _U
        + "SELECT 'E' || place AS edge_id, source_key, target_key, source_node_id, target_node_id, source_name, target_name, count, in_cycle FROM shown",
        "mermaid_lines": _U + _LINES + "SELECT section, a::INTEGER AS a, b::INTEGER AS b, line FROM lines",
        "mermaid_text": _U + _LINES + "SELECT string_agg(line, chr(10) ORDER BY section, a, b) AS mermaid FROM lines",
        "escape_labels": r"""SELECT p_partkey, '&lt;''' || replace(replace(replace(replace(replace(p_name, '\', '/'), '<', '&lt;'), '>', '&gt;'), '"', ''''), '#', '&#35;')
            || '/&#35;&gt;' || replace(p_brand, '#', '&#35;') AS label FROM part""",
        "neighbourhood": _S
        + """, near AS (SELECT source_key AS key FROM edges WHERE source_key = 3 OR target_key = 3 UNION SELECT target_key FROM edges WHERE source_key = 3 OR target_key = 3)
             SELECT key, key = 3 AS is_selected, key IN (SELECT key FROM near) AND key <> 3 AS is_related, key NOT IN (SELECT key FROM near) AND key <> 3 AS is_dimmed,
             (SELECT count(*) FROM edges WHERE source_key = n.key OR target_key = n.key) AS incident_edges FROM nodes n""",
        "neighbourhood_edges": _S + "SELECT *, source_key = 3 OR target_key = 3 AS is_related, NOT (source_key = 3 OR target_key = 3) AS is_dimmed FROM edges",
        "cycle_highlight": _S
        + """SELECT source_key, target_key, 'user-' || source_key AS source_name, 'user-' || target_key AS target_name, count FROM edges
             WHERE source_key IN (3, 5, 8, 13) AND target_key IN (3, 5, 8, 13)""",
        "cycle_members": _U
        + """SELECT scc_id, ((i - 1) // 4)::INTEGER AS chunk, (i - 1)::INTEGER AS position, nodes[i] AS name
             FROM (SELECT scc_id, nodes, unnest(range(1, len(nodes) + 1)) AS i FROM found)""",
        "cycle_list": _U + "SELECT rank::INTEGER AS rank, scope || ': (' || length || ') ' || array_to_string(nodes, ' → ') AS label FROM found",
        "cycle_diagnostics_anchored": _U + "," + _TEXT + "SELECT file, string_agg(message, '|' ORDER BY s, rank, pos) AS messages FROM anchored GROUP BY file",
        "cycle_diagnostics_unanchored": _U + "," + _TEXT + "SELECT rank::INTEGER AS rank, pos::INTEGER AS pos, message FROM loose",
        "status_messages": _U
        + """, c AS (SELECT (SELECT count(*) FROM drawn) AS n, (SELECT count(*) FROM shown) AS m, (SELECT count(*) FROM found) AS k)
             SELECT 'Project graph: ' || format('{:,}', n) || ' node(s), ' || format('{:,}', m) || ' dependency edge(s).' ||
               CASE WHEN k > 0 THEN ' ' || format('{:,}', k) || ' circular dependency group(s) highlighted in red.' ELSE '' END AS status,
             format('{:,}', n) || ' node(s), ' || format('{:,}', m) || ' edge(s), ' || format('{:,}', k) || ' cycle(s).' AS summary,
             'user-3: highlighted ' || format('{:,}', n * 1000) || ' connected reference(s). Click the node again or the background to clear.' AS selected,
             'My_1_app-project.svg' AS file_name FROM c""",
        "view_model_meta": _U
        + """SELECT '/a/b.sln' AS solution_path, '' AS solution_name, (SELECT count(*) FROM nodes) AS project_count, 0::BIGINT AS namespace_count,
             (SELECT count(*) FROM found)::INTEGER AS project_cycle_count, 0::INTEGER AS namespace_cycle_count""",
        "parse_sln_lines": r"""
            SELECT '{2150e333-8fdc-42a3-9474-1a3956d46de8}' AS type_guid, r_name AS name, r_name AS relative_path, '{R' || r_regionkey || '}' AS guid FROM region
            UNION ALL SELECT '{FAE04EC0}', n_name, lower(n_name) || '\' || n_name || CASE WHEN n_nationkey % 6 = 5 THEN '.txt' ELSE '.csproj' END, '{n' || n_nationkey || '}' FROM nation""",
        "parse_nested_projects": "SELECT '{N' || n_nationkey || '}' AS child, '{R' || n_regionkey || '}' AS parent FROM nation WHERE n_nationkey % 5 <> 0",
        "solution_projects": """
            SELECT '{n' || n_nationkey || '}' AS id, n_name AS name, '/s/' || lower(n_name) || '/' || n_name || '.csproj' AS full_path,
              lower(n_name) || '/' || n_name || '.csproj' AS relative_path, CASE WHEN n_nationkey % 5 <> 0 THEN r_name ELSE lower(n_name) END AS group_path
            FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 6 <> 5""",
        "parse_project_refs": """
            SELECT p_partkey, '/s/' || (p_partkey + 1) || '/' || (p_partkey + 1) || '.csproj' AS target_key, p_partkey % 2 = 0 AS is_conditional FROM part WHERE p_partkey % 50 <> 0""",
        "parse_package_refs": "SELECT p_partkey, p_brand AS packages FROM part WHERE p_partkey % 50 <> 0",
        "project_kinds": """
            SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN NULL WHEN p_size % 4 = 0 THEN 'web' WHEN p_size % 5 = 0 THEN 'desktop' WHEN p_size % 3 = 0 THEN 'app' ELSE 'library' END AS kind,
              CASE WHEN p_partkey % 50 <> 0 THEN 'net' || p_size END AS framework, p_partkey % 50 = 0 AS failed FROM part""",
        "parse_csharp_usings": """
            SELECT o_orderkey, 'A.B' || o_orderkey || ',A.B' || o_orderkey || '.In' AS namespaces, 'Sys.O' || o_orderkey || ',Lib.S' || o_custkey || ',Yes.E,Late.U' AS usings,
              'G' || o_orderstatus AS global_usings FROM orders""",
        "scan_filter_cap": """
            WITH f AS (SELECT doc_id, source, n_chars * 100 AS length FROM documents), first AS (
              SELECT * FROM f WHERE length <= 400000 ORDER BY source, doc_id LIMIT 300), last AS (SELECT source AS s, doc_id AS d FROM first ORDER BY source DESC, doc_id DESC LIMIT 1)
            SELECT doc_id, length, (SELECT count(*) FROM first) >= 300 AND EXISTS (SELECT 1 FROM f, last WHERE f.source > s OR (f.source = s AND f.doc_id > d)) AS truncated FROM first""",
        "source_scan": """
            WITH c AS (
              SELECT o_custkey AS k, string_agg('using O' || o_orderkey || ';', chr(10) ORDER BY o_orderkey) || chr(10) || 'namespace C' || o_custkey || ';' AS content,
                string_agg('O' || o_orderkey, ',' ORDER BY o_orderkey) AS usings FROM orders GROUP BY o_custkey)
            SELECT 'p' || (k % 25) AS project, 'p' || (k % 25) || ['/', '/src/_gen/', '', '/.hidden/a/', '/deep/er/b/', '', '/src/'][k % 7 + 1] || 'C' || k || '.cs' AS file,
              strlen(content) AS length, 'C' || k AS namespaces, usings FROM c WHERE k % 7 NOT IN (2, 5) AND k % 11 <> 0 AND strlen(content) <= 300""",
        "solution_pick_list": """
            WITH s AS (
              SELECT p_partkey AS k, lower(replace(p_type, ' ', '/')) || '/' AS folder,
                CASE p_partkey % 3 WHEN 0 THEN replace(lower(p_brand), 'a', 'ä') WHEN 1 THEN upper(p_brand) ELSE lower(p_brand) END AS name,
                '/p' || lpad(p_partkey::VARCHAR, 9, '0') || '.sln' AS rest FROM part)
            SELECT (row_number() OVER (ORDER BY lower(strip_accents(folder || name || rest)), k % 3 = 0, k % 3 = 1) - 1)::INTEGER AS position,
              '/s/' || folder || name || rest AS path, folder || name || rest AS relative_path FROM s QUALIFY position < 100""",
        "parsed_files_cap": """
            WITH first AS (
              SELECT * FROM orders WHERE floor(o_totalprice) <= 200000 AND o_custkey % 3 <> 0 ORDER BY o_custkey, o_orderkey LIMIT 300),
            last AS (SELECT o_custkey AS c, o_orderkey AS k FROM first ORDER BY o_custkey DESC, o_orderkey DESC LIMIT 1)
            SELECT o_orderkey, 'N.S' || o_orderstatus AS namespaces, 'U.C' || o_custkey AS usings,
              (SELECT count(*) FROM first) >= 300 AND EXISTS (SELECT 1 FROM orders o, last WHERE o.o_custkey > c OR (o.o_custkey = c AND o.o_orderkey > k)) AS truncated FROM first""",
        "report_reader": _N
        + """SELECT 'edge' AS section, (row_number() OVER (ORDER BY count DESC, source_name, target_name, source_key, target_key) - 1)::INTEGER AS position,
               source_name || '>' || target_name AS name, count AS first, 0::BIGINT AS second FROM named
             WHERE source_key IN (SELECT key FROM top) AND target_key IN (SELECT key FROM top) QUALIFY position < 15
             UNION ALL SELECT 'hub', (row_number() OVER (ORDER BY outgoing + incoming DESC, package_references DESC, name, key) - 1)::INTEGER AS position, name, outgoing, incoming
             FROM degrees QUALIFY position < 6
             UNION ALL SELECT 'kind', (row_number() OVER (ORDER BY count(*) DESC, kind) - 1)::INTEGER, kind, count(*), 0 FROM nodes GROUP BY kind
             UNION ALL SELECT 'project', (row_number() OVER (ORDER BY name, key) - 1)::INTEGER, concat_ws(' ', name, lower(name) || '.csproj', group_path, kind, 'net' || key),
               outgoing, package_references::BIGINT FROM degrees""",
        "report_file": """
            SELECT 'project' AS section, (row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1)::INTEGER AS position,
              'o' || o_orderkey || ' ' || o_orderstatus || ' ' || o_custkey AS text FROM orders
            UNION ALL SELECT 'warning', (row_number() OVER (ORDER BY o_orderkey) - 1)::INTEGER, 'large "o' || o_orderkey || '"' FROM orders WHERE o_totalprice >= 300000
            UNION ALL SELECT 'cycle', (row_number() OVER (ORDER BY o_custkey) - 1)::INTEGER, count(*) || ' ' || string_agg('o' || o_orderkey, ',' ORDER BY 'o' || o_orderkey)
            FROM orders GROUP BY o_custkey""",
        "report_notes": f"WITH RECURSIVE {_NATION} {_MESSAGES} SELECT kind, (row_number() OVER (PARTITION BY kind ORDER BY o) - 1)::INTEGER AS position, text FROM said",
        "slnx_projects": """
            SELECT CASE WHEN n_nationkey % 4 = 0 THEN 'n' || n_nationkey ELSE '/s/' || lower(n_name) || '/' || n_name || '.csproj' END AS id, n_name AS name,
              '/s/' || lower(n_name) || '/' || n_name || '.csproj' AS full_path, lower(n_name) || '/' || n_name || '.csproj' AS relative_path,
              CASE WHEN n_nationkey % 5 = 0 THEN lower(n_name) ELSE r_name END AS group_path
            FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 6 <> 5""",
        "diagnostic_rows": _U
        + ","
        + _TEXT
        + "SELECT file, 0::INTEGER AS line, 0::INTEGER AS col, 'Warning' AS severity, 'graphloom' AS source, message FROM anchored",
        "namespace_diagram_nodes": _P
        + "SELECT 'P' || position AS node_id, key, kind, group_name, group_position::INTEGER AS group_position, in_cycle, representative_file FROM drawn",
        "namespace_diagram_edges": _P + "SELECT 'E' || place AS edge_id, source_node_id, target_node_id, source_name, target_name, count, in_cycle FROM shown",
        "namespace_cycles": _P + "SELECT rank::INTEGER AS rank, scope, array_to_string(nodes, ',') AS nodes, length::INTEGER AS length, scc_id FROM found",
        "namespace_notes": _P
        + """, numbers AS (
              SELECT (SELECT count(DISTINCT project) FROM declared) AS projects, least(500, (SELECT count(DISTINCT record) FROM declared)) AS files,
                (SELECT count(DISTINCT record) FROM declared) > 500 AS truncated, (SELECT count(*) FROM nodes) AS spaces, (SELECT count(*) FROM edges) AS links,
                (SELECT count(*) FROM drawn) AS drawn, (SELECT count(*) FROM shown) AS shown
            ), texts AS (
              SELECT 'whole' AS solution, 1 AS o, 'Namespace edges are derived from `using` directives among ' || spaces || ' solution namespace(s) (C# syntax only).' AS note FROM numbers
              UNION ALL SELECT 'whole', 2, 'Parsed ' || files || ' C# source file(s) across ' || projects || ' C# project(s).' FROM numbers
              UNION ALL SELECT 'whole', 3, 'Source scan stopped after 500 files; namespace data may be incomplete.' FROM numbers WHERE truncated
              UNION ALL SELECT 'whole', 4, 'Namespace diagram truncated to the top ' || drawn || ' of ' || spaces || ' namespaces.' FROM numbers WHERE drawn < spaces
              UNION ALL SELECT 'whole', 5, 'Showing the top ' || shown || ' of ' || links || ' namespace dependency edges.' FROM numbers WHERE shown < links
              UNION ALL SELECT 'bare', 1, 'Parsed ' || files || ' C# file(s), but found no namespace declarations (top-level statements are skipped).' FROM numbers
              UNION ALL SELECT 'other', 1, 'Namespace analysis runs on C# projects only; no .csproj files were found.'
            ) SELECT solution, (row_number() OVER (PARTITION BY solution ORDER BY o) - 1)::INTEGER AS position, note FROM texts""",
        "namespace_mermaid": _P + _LINES + "SELECT string_agg(line, chr(10) ORDER BY section, a, b) AS mermaid FROM lines",
        "href_references": """
            WITH links AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages)
            SELECT target, count(*) AS "references", count(DISTINCT page_id) AS pages FROM links GROUP BY target""",
    }
