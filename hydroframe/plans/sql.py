"""The derived relations as SQL, to put before a query of them."""

from __future__ import annotations

START, END = 30000, 2000000

CTES = {
    "ev": "SELECT user_id, 21600 * floor((epoch(ts) - 1704067200) / 21600) AS t, value FROM events",
    "steps": "SELECT DISTINCT t FROM ev",
    "nodes": "SELECT DISTINCT user_id AS id, (user_id % 15 * 10)::DOUBLE AS x, (user_id // 15 * 10)::DOUBLE AS y, (100 + 10 * (user_id % 7))::DOUBLE AS sumax, (user_id % 5 - 2)::DOUBLE AS dmax, (1 + user_id % 7)::INTEGER AS node_type FROM events",
    "buckets": "SELECT user_id AS entity_id, t, avg(value) AS s1, sum(value) AS vol FROM ev GROUP BY ALL",
    "node_ts": "SELECT n.id AS entity_id, s.t, b.s1, b.vol, CASE WHEN b.vol IS NULL AND n.id % 10 = 0 THEN NULL ELSE coalesce(b.vol, 0) / 1000 END AS rain, b.s1 - 20 AS ucx, 10 - b.s1 / 2 AS ucy FROM nodes n CROSS JOIN steps s LEFT JOIN buckets b ON b.entity_id = n.id AND b.t = s.t",
    "lines": "SELECT a.id, a.id AS start_id, b.id AS end_id, ([51, 100, 3, 101, 200])[a.id % 5 + 1] AS kcu, 'v2_' || CASE a.id % 3 WHEN 0 THEN 'pipe' WHEN 1 THEN 'channel' ELSE 'added_c' END AS content_type, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM nodes a JOIN nodes b ON b.id = (a.id * 7 + 3) % ((SELECT max(id) FROM nodes) + 1) AND a.id <> b.id",
    "line_ts": "SELECT entity_id, t, kcu, q, q / 10 AS u1 FROM (SELECT n.entity_id, n.t, l.kcu, CASE WHEN s1 IS NULL AND n.entity_id % 10 <> 0 THEN 0 ELSE s1 - 20 END AS q FROM node_ts n JOIN lines l ON l.id = n.entity_id)",
    "pixels": "SELECT (l_partkey % 100)::INTEGER AS row, (l_suppkey % 100)::INTEGER AS col, min(l_quantity) AS z, max(l_quantity) AS zmax FROM lineitem GROUP BY ALL",
    "landuse": "SELECT row, col, (1 + row * col % 30)::INTEGER AS code, (1 + (row + col) % 21)::INTEGER AS soil FROM pixels",
    "pipes": "SELECT s_suppkey AS id, s_suppkey AS src, s_suppkey // 2 AS dst, (10 + s_suppkey % 7)::DOUBLE AS length, (200 + 100 * (s_suppkey % 4))::DOUBLE AS diameter, round(s_acctbal / 1000, 3) AS ground, (s_suppkey % 3)::INTEGER AS edit FROM supplier WHERE s_suppkey > 1",
    "w": f"SELECT t, greatest(t, {START}) AS te, least(nxt, {END}) - greatest(t, {START}) AS dt FROM (SELECT t, lead(t) OVER (ORDER BY t) AS nxt FROM steps) WHERE nxt IS NOT NULL AND least(nxt, {END}) > greatest(t, {START})",
    "node_w": "SELECT n.*, w.te, w.dt FROM node_ts n JOIN w USING (t)",
    "line_w": "SELECT n.*, w.te, w.dt FROM line_ts n JOIN w USING (t)",
    "line_q": "SELECT entity_id AS id, CASE WHEN count(q) < count(*) THEN NULL ELSE sum(CASE WHEN kcu BETWEEN 51 AND 58 THEN -q ELSE q END * dt) END AS q FROM line_w GROUP BY entity_id",
}

NEEDS = {
    "ev": [], "steps": ["ev"], "nodes": [], "buckets": ["ev"], "node_ts": ["nodes", "steps", "buckets"], "lines": ["nodes"], "line_ts": ["node_ts", "lines"], "pixels": [], "landuse": ["pixels"], "pipes": [], "w": ["steps"],
    "node_w": ["node_ts", "w"], "line_w": ["line_ts", "w"], "line_q": ["line_w"],
}


def relations(*names: str, extra: str = "", recursive: bool = False) -> str:
    """A WITH clause of these relations and of what they need, then any extra ones."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in NEEDS[name]:
            visit(n)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({CTES[n]})" for n in order] + ([extra] if extra else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(parts) + " "
