"""DuckDB SQL for the registered network queries, on the same tables."""

from __future__ import annotations

from causeway.queries import LEVEL, SWEEP

_KEYS = {"supplier": ("s_suppkey", "s_acctbal", "s_nationkey"), "customer": ("c_custkey", "c_acctbal", "c_nationkey")}
_CLASSES = "['motorway','trunk','primary','secondary','tertiary','residential','living_street','service','unclassified']"


def _case(values: str, default: str) -> str:
    return f"coalesce(({values})[1 + nation % 9], {default})"


def _net(table: str) -> str:
    """Common table expressions: nodes (with elevation), streets, arcs and both (undirected edges both ways)."""
    key, balance, nation = _KEYS[table]
    return f"""
    base AS (SELECT {key}::BIGINT AS id, abs(round({balance} * 100)::BIGINT) AS c, {nation}::BIGINT AS nation FROM {table}),
    side AS (SELECT count(*) AS n, floor(sqrt(count(*)))::BIGINT AS w FROM base),
    grid AS (SELECT *, id % w AS gc, id // w AS gr, (c % 100 - 50) * 9e-6 AS j FROM base, side),
    flat AS (SELECT id, 7762e-2 + 4e-3 * gc + j AS x, 1293e-2 + 34e-4 * gr + j AS y, CASE WHEN nation % 8 = 0 THEN 'hospital' END AS amenity FROM grid),
    box AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM flat),
    share AS (SELECT *, (x - x0) / coalesce(nullif(x1 - x0, 0), 1) AS s, (y - y0) / coalesce(nullif(y1 - y0, 0), 1) AS t FROM flat, box),
    nodes AS (SELECT id, x, y, amenity, round(6.0::DOUBLE + 46.0::DOUBLE * (abs(s - t) + 5e-2 * sin(628e-2 * (s + t))), 2) AS elevation FROM share),
    raw AS (
        SELECT id AS u, id + 1 AS v, nation, c % 11 = 0 AS oneway FROM grid WHERE gc < w - 1 AND id + 1 < n AND c % 5 <> 0
        UNION ALL SELECT id, id + w, nation, c % 11 = 0 FROM grid WHERE id + w < n AND (c // 5) % 5 <> 0),
    streets AS (
        SELECT u, v, oneway, ({_CLASSES})[1 + nation % 9] AS highway,
            ([70.0,55,45,38,32,24,12,16,28]::DOUBLE[])[1 + nation % 9] AS speed, ([2200.0,1600,1200,900,600,400,150,200,500]::DOUBLE[])[1 + nation % 9] AS capacity,
            2 * 6371000::DOUBLE * asin(sqrt(pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2))) AS w
        FROM raw JOIN nodes a ON a.id = u JOIN nodes b ON b.id = v),
    arcs AS (SELECT u, v, highway, speed, capacity, w FROM streets UNION ALL SELECT v, u, highway, speed, capacity, w FROM streets WHERE NOT oneway),
    edges AS (SELECT u, v, highway, speed, capacity, w FROM streets),
    ways AS (SELECT u, v, w FROM edges UNION ALL SELECT v, u, w FROM edges)
    """


def _paths(ways: str = "ways", sources: str = "SELECT id FROM nodes", name: str = "d") -> str:
    return f"""{name}(s, v, d) USING KEY (s, v) AS (
        SELECT id, id, 0::DOUBLE FROM ({sources}) q
        UNION (SELECT {name}.s, e.v, min({name}.d + e.w) FROM {name} JOIN {ways} e ON e.u = {name}.v LEFT JOIN recurring.{name} r ON r.s = {name}.s AND r.v = e.v
            WHERE {name}.d + e.w < coalesce(r.d, 1e300) - 1e-9 GROUP BY {name}.s, e.v))"""


def _components(ways: str = "ways", ids: str = "SELECT id FROM nodes", name: str = "cc") -> str:
    return f"""{name}(id, component) USING KEY (id) AS (
        SELECT id, id FROM ({ids}) q
        UNION (SELECT e.v, min({name}.component) FROM {name} JOIN {ways} e ON e.u = {name}.id JOIN recurring.{name} r ON r.id = e.v
            WHERE {name}.component < r.component GROUP BY e.v))"""


def _scenario_components(ways: str, ids: str, name: str = "cc") -> str:
    """Components of scenario-keyed edges (g, u, v)."""
    return f"""{name}(g, id, component) USING KEY (g, id) AS (
        SELECT g, id, id FROM ({ids}) q
        UNION (SELECT e.g, e.v, min({name}.component) FROM {name} JOIN {ways} e ON e.g = {name}.g AND e.u = {name}.id JOIN recurring.{name} r ON r.g = e.g AND r.id = e.v
            WHERE {name}.component < r.component GROUP BY e.g, e.v))"""


#: Numbers of shortest paths from distances d: by rising distance, counted hop by hop over the tight edges.
_SIGMA = """tight AS (SELECT a.s, a.v AS u, b.v FROM d a JOIN ways e ON e.u = a.v JOIN d b ON b.s = a.s AND b.v = e.v WHERE abs(a.d + e.w - b.d) <= 1e-9),
    sg(s, v, k, n) AS (SELECT s, v, 0, 1::DOUBLE FROM d WHERE s = v UNION ALL SELECT * FROM (SELECT t.s, t.v, sg.k + 1, sum(sg.n) FROM sg JOIN tight t ON t.s = sg.s AND t.u = sg.v GROUP BY t.s, t.v, sg.k) q),
    sigma AS (SELECT s, v, sum(n) AS n FROM sg GROUP BY s, v)"""

_PAIRS = """SELECT least(e.u, e.v) AS u, greatest(e.u, e.v) AS v, sum(su.n * sv.n / st.n) AS total
    FROM ways e JOIN d a ON a.v = e.u JOIN d b ON b.s = e.v JOIN d c ON c.s = a.s AND c.v = b.v
    JOIN sigma su ON su.s = a.s AND su.v = e.u JOIN sigma sv ON sv.s = e.v AND sv.v = b.v JOIN sigma st ON st.s = a.s AND st.v = b.v
    WHERE abs(a.d + e.w + b.d - c.d) <= 1e-9 AND a.s <> b.v GROUP BY ALL"""

_SWEEP = ", ".join(f"({i}, {x}::DOUBLE)" for i, x in enumerate(SWEEP))


def _flood(levels: str) -> str:
    return f"""WITH RECURSIVE {_net("customer")},
    levels(g, level) AS (VALUES {levels}), stages AS (SELECT * FROM levels UNION ALL SELECT -1, '-Infinity'::DOUBLE),
    low AS (SELECT u, v, least(a.elevation, b.elevation) AS low FROM edges JOIN nodes a ON a.id = u JOIN nodes b ON b.id = v),
    dry AS (SELECT g, u, v FROM low, stages WHERE low >= level UNION ALL SELECT g, v, u FROM low, stages WHERE low >= level),
    {_scenario_components("dry", "SELECT g, id FROM stages, nodes")},
    served AS (SELECT DISTINCT cc.g, cc.component FROM cc JOIN nodes USING (id) WHERE amenity = 'hospital'),
    access AS (SELECT cc.g, cc.id FROM cc JOIN served USING (g, component))
    """


_IMPACT = """SELECT level, (SELECT count(*) FROM low WHERE low < level) AS submerged_count, had - still AS lost_access_count, round((had - still)::DOUBLE / total, 4) AS lost_access_fraction, after AS with_access_after, total AS nodes_total
    FROM levels l, (SELECT count(*) AS had FROM access WHERE g = -1) h, (SELECT count(*) AS total FROM nodes) t,
    LATERAL (SELECT count(*) AS after, count(*) FILTER (id IN (SELECT id FROM access WHERE g = -1)) AS still FROM access a WHERE a.g = l.g) k"""

_INSIDE = """CASE WHEN {0} THEN 'canopy' WHEN {1} THEN 'shadow' END"""


def _quad(points: tuple) -> str:
    """Even-odd test of x, y against a polygon of literal places."""
    places = [(f"(7762e-2 + {a}::DOUBLE * 4e-3)", f"(1293e-2 + {b}::DOUBLE * 34e-4)") for a, b in points]
    tests = [f"((({ay} > y) <> ({by} > y)) AND x < ({bx} - {ax}) * (y - {ay}) / ({by} - {ay}) + {ax})::INT" for (ax, ay), (bx, by) in zip(places, places[-1:] + places[:-1], strict=True)]
    return f"({' + '.join(tests)}) % 2 = 1"


def _raster(radius: int, name: str) -> str:
    """Pixels of the supplier grid's streets: axis-aligned lines, thickened by a disk."""
    return f"""lines AS (SELECT (u // s.w) * 12 + 6 AS r0, (u % s.w) * 12 + 6 AS c0, (v // s.w) * 12 + 6 AS r1, (v % s.w) * 12 + 6 AS c1 FROM edges, side s),
    core AS (SELECT DISTINCT r0 + k * sign(r1 - r0) AS r, c0 + k * sign(c1 - c0) AS c FROM lines, LATERAL (SELECT unnest(range(greatest(abs(r1 - r0), abs(c1 - c0)) + 1)) AS k) q),
    {name} AS (SELECT DISTINCT r + dr AS r, c + dc AS c FROM core, (SELECT unnest(range(-{radius}, {radius + 1})) AS dr) a, (SELECT unnest(range(-{radius}, {radius + 1})) AS dc) b
        WHERE dr * dr + dc * dc <= {radius * radius} AND r + dr BETWEEN 0 AND 99999 AND c + dc BETWEEN 0 AND 99999)"""


def _with(table: str, *more: str) -> str:
    return "WITH RECURSIVE " + ", ".join([_net(table), *more])


_BRIDGES = f"""{_with("supplier")}, cut AS (SELECT row_number() OVER (ORDER BY u, v) AS g, u, v FROM edges),
    alive AS (SELECT cut.g, e.u, e.v FROM cut, ways e WHERE NOT (least(e.u, e.v) = cut.u AND greatest(e.u, e.v) = cut.v)),
    {_scenario_components("alive", "SELECT g, id FROM cut, nodes")},
    bridge AS (SELECT cut.u, cut.v FROM cut JOIN cc a ON a.g = cut.g AND a.id = cut.u JOIN cc b ON b.g = cut.g AND b.id = cut.v WHERE a.component <> b.component)"""

#: Every pair of segments is taken out: nodes that are parted by none of these losses are together.
_THREE = f"""{_with("supplier")}, cut AS (SELECT row_number() OVER (ORDER BY a.u, a.v, b.u, b.v) AS g, a.u AS u1, a.v AS v1, b.u AS u2, b.v AS v2 FROM edges a JOIN edges b ON (a.u, a.v) < (b.u, b.v)),
    alive AS (SELECT cut.g, e.u, e.v FROM cut, ways e WHERE (least(e.u, e.v), greatest(e.u, e.v)) NOT IN ((cut.u1, cut.v1), (cut.u2, cut.v2))),
    {_scenario_components("alive", "SELECT g, id FROM cut, nodes")},
    seen AS (SELECT id, md5(string_agg(component::VARCHAR, ',' ORDER BY g)) AS seen FROM cc GROUP BY id)
    SELECT id, min(id) OVER (PARTITION BY seen) AS component FROM seen"""

_QUADS = ((("0.2", "0.3"), ("5.1", "0.1"), ("4.7", "4.2"), ("0.4", "3.6")), (("2.5", "2.5"), ("8.3", "2.2"), ("7.9", "6.8"), ("3.1", "7.2")))

ORACLE_SQL: dict[str, str] = {
    "flood_impact": _flood(f"(0, {LEVEL}::DOUBLE)") + _IMPACT,
    "flood_sweep": _flood(_SWEEP) + _IMPACT,
    "lost_access": _flood(f"(0, {LEVEL}::DOUBLE)") + "SELECT id FROM access WHERE g = -1 AND id NOT IN (SELECT id FROM access WHERE g = 0)",
    "annotate_edges": _with("customer") + "SELECT u, v, highway, round(w, 4) AS length_m, round(w / (speed * 1000 / 3600), 4) AS travel_time_s, capacity FROM arcs",
    "undirected_view": _with("customer") + "SELECT u, v, highway, round(w, 4) AS w FROM edges",
    "collapse_parallel": """SELECT l_suppkey AS u, l_partkey AS v, l_orderkey, l_linenumber, l_extendedprice FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) = 1""",
    "bipartite_degree": "SELECT l_suppkey AS id, count(*) AS degree, count(DISTINCT l_partkey) AS neighbours FROM lineitem GROUP BY 1",
    "zones": _with("customer")
    + """SELECT 'west' AS zone, id FROM nodes, box WHERE x <= x0 + 22e-2 * (x1 - x0) UNION ALL SELECT 'east', id FROM nodes, box WHERE x >= x1 - 22e-2 * (x1 - x0)
        UNION ALL SELECT 'north', id FROM nodes, box WHERE y >= y1 - 22e-2 * (y1 - y0) UNION ALL SELECT 'south', id FROM nodes, box WHERE y <= y0 + 22e-2 * (y1 - y0)
        UNION ALL SELECT 'amenity:hospital', id FROM nodes WHERE amenity = 'hospital' UNION ALL SELECT 'ids:1,2,3,999999', id FROM nodes WHERE id IN (1, 2, 3, 999999)""",
    "elevation": _with("customer") + "SELECT id, elevation FROM nodes",
    "degree": _with("customer") + "SELECT u AS id, count(*) AS degree FROM ways GROUP BY 1",
    "submerged_edges": _with("customer") + f"SELECT u, v FROM edges JOIN nodes a ON a.id = u JOIN nodes b ON b.id = v WHERE least(a.elevation, b.elevation) < {LEVEL}",
    "components": _with("customer", _components()) + "SELECT id, component FROM cc",
    "component_summary": _with("customer", _components())
    + "SELECT count(*) AS components, max(size) AS largest, sum(size)::BIGINT AS nodes, sum(size * (size - 1))::BIGINT AS pairs FROM (SELECT component, count(*) AS size FROM cc GROUP BY 1)",
    "bridges": _BRIDGES + "SELECT u, v FROM bridge",
    "two_edge_components": _BRIDGES + ", joined AS (SELECT e.u, e.v FROM ways e LEFT JOIN bridge b ON b.u = least(e.u, e.v) AND b.v = greatest(e.u, e.v) WHERE b.u IS NULL), " + _components("joined", name="tc") + "SELECT id, component FROM tc",
    "three_edge_components": _THREE,
    "articulation_points": _with("supplier", "hub AS (SELECT u AS g FROM ways GROUP BY 1 HAVING count(*) > 1)", "alive AS (SELECT g, u, v FROM hub, ways WHERE u <> g AND v <> g)", _scenario_components("alive", "SELECT g, id FROM hub, nodes WHERE id <> g"))
    + "SELECT e.u AS id FROM ways e JOIN cc ON cc.g = e.u AND cc.id = e.v GROUP BY 1 HAVING count(DISTINCT component) > 1",
    "apsp": _with("supplier", _paths()) + "SELECT s, v, round(d, 4) AS d FROM d",
    "sssp_hops": _with("supplier", "hops AS (SELECT u, v, 1::DOUBLE AS w FROM ways)", _paths("hops")) + "SELECT s, v, d::BIGINT AS hops FROM d",
    "sigma_counts": _with("supplier", "hops AS (SELECT u, v, 1::DOUBLE AS w FROM ways)", _paths("hops"), _SIGMA.replace("JOIN ways e", "JOIN hops e")) + "SELECT s, v, n::BIGINT AS sigma FROM sigma",
    "global_efficiency": _with("supplier", _paths()) + "SELECT round(sum(1 / d) / (max(n) * (max(n) - 1)), 9) AS efficiency FROM d, side WHERE d > 0",
    "edge_betweenness": _with("supplier", _paths(), _SIGMA) + f"SELECT e.u, e.v, round(coalesce(total, 0) / (n * (n - 1)), 8) AS betweenness FROM edges e LEFT JOIN ({_PAIRS}) p ON p.u = e.u AND p.v = e.v, side",
    "edge_betweenness_directed": _with("supplier", "one AS (SELECT u, v, w FROM arcs)", _paths("one"), _SIGMA.replace("JOIN ways e", "JOIN one e"))
    + f"SELECT e.u, e.v, round(coalesce(total, 0) / (n * (n - 1)), 8) AS betweenness FROM one e LEFT JOIN ({_PAIRS.replace('least(e.u, e.v) AS u, greatest(e.u, e.v) AS v', 'e.u, e.v').replace('FROM ways e', 'FROM one e')}) p ON p.u = e.u AND p.v = e.v, side",
    "node_betweenness": _with("supplier", _paths(), _SIGMA)
    + """, through AS (SELECT a.v AS id, sum(su.n * sv.n / st.n) AS total FROM d a JOIN d b ON b.s = a.v JOIN d c ON c.s = a.s AND c.v = b.v
        JOIN sigma su ON su.s = a.s AND su.v = a.v JOIN sigma sv ON sv.s = a.v AND sv.v = b.v JOIN sigma st ON st.s = a.s AND st.v = b.v
        WHERE a.s <> a.v AND b.v <> a.v AND a.s <> b.v AND abs(a.d + b.d - c.d) <= 1e-9 GROUP BY 1)
        SELECT u AS id, round(coalesce(max(total), 0) / (max(n - 1) * max(n - 2)), 8) AS betweenness FROM ways LEFT JOIN through ON through.id = ways.u, side GROUP BY 1""",
    "sampled_betweenness": _with("supplier", _paths(), _SIGMA)
    + """, drawn AS (SELECT user_id % n AS s, count(*) AS k FROM events, side GROUP BY 1),
        each AS (SELECT a.s, least(e.u, e.v) AS u, greatest(e.u, e.v) AS v, sum(su.n * sv.n / st.n) AS total
            FROM ways e JOIN d a ON a.v = e.u JOIN d b ON b.s = e.v JOIN d c ON c.s = a.s AND c.v = b.v
            JOIN sigma su ON su.s = a.s AND su.v = e.u JOIN sigma sv ON sv.s = e.v AND sv.v = b.v JOIN sigma st ON st.s = a.s AND st.v = b.v
            WHERE abs(a.d + e.w + b.d - c.d) <= 1e-9 AND a.s <> b.v GROUP BY ALL)
        SELECT e.u, e.v, round(coalesce(sum(k * total), 0) / (SELECT sum(k) FROM drawn) / (SELECT n - 1 FROM side), 8) AS betweenness
        FROM edges e LEFT JOIN each ON each.u = e.u AND each.v = e.v LEFT JOIN drawn ON drawn.s = each.s GROUP BY 1, 2""",
    "progressive_epsilon": _with("supplier")
    + """SELECT batch, samples, round(least(1, sqrt(ln(2 * m / 1e-1) / (2 * samples))), 6) AS epsilon FROM
        (SELECT batch, sum(k) OVER (ORDER BY batch)::BIGINT AS samples FROM (SELECT event_id // 1000 AS batch, count(*) AS k FROM events GROUP BY 1)), (SELECT count(*) AS m FROM edges)""",
    "removal_impact": _with("supplier", "cut_edge AS (SELECT row_number() OVER (ORDER BY u, v) AS g, u, v FROM edges)", "groups AS (SELECT g FROM cut_edge UNION ALL SELECT -1)",
        "alive AS (SELECT gr.g, e.u, e.v, e.w FROM groups gr LEFT JOIN cut_edge l USING (g), ways e WHERE l.u IS NULL OR NOT (least(e.u, e.v) = l.u AND greatest(e.u, e.v) = l.v))",
        """d(g, s, v, d) USING KEY (g, s, v) AS (SELECT g, id, id, 0::DOUBLE FROM groups, nodes UNION (SELECT d.g, d.s, e.v, min(d.d + e.w) FROM d JOIN alive e ON e.g = d.g AND e.u = d.v
            LEFT JOIN recurring.d r ON r.g = d.g AND r.s = d.s AND r.v = e.v WHERE d.d + e.w < coalesce(r.d, 1e300) - 1e-9 GROUP BY d.g, d.s, e.v))""",
        _scenario_components("alive", "SELECT g, id FROM groups, nodes"))
    + """, eff AS (SELECT g, sum(1 / d) AS e FROM d WHERE d > 0 GROUP BY 1), part AS (SELECT g, max(k) AS lcc, sum(k * (k - 1)) AS pairs FROM (SELECT g, component, count(*) AS k FROM cc GROUP BY 1, 2) GROUP BY 1)
        SELECT l.u, l.v, round((b.e - a.e) / b.e, 6) AS relative_drop, pb.lcc AS lcc_before, pa.lcc AS lcc_after, pa.lcc < pb.lcc AS fragmented, greatest(pb.pairs - pa.pairs, 0)::BIGINT AS newly_disconnected_pairs
        FROM cut_edge l JOIN eff a USING (g) JOIN part pa USING (g), eff b, part pb WHERE b.g = -1 AND pb.g = -1""",
    "spearman": """WITH r AS (SELECT rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2 AS a, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2 AS b FROM orders)
        SELECT round(corr(a, b), 6) AS r FROM r""",
    "pearson": "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem",
    "bpr_travel_time": _with("customer")
    + """, volume AS (SELECT o_custkey AS u, count(*) * 100 AS q FROM orders GROUP BY 1), timed AS (SELECT *, w / (speed * 1000 / 3600) AS t0 FROM arcs LEFT JOIN volume USING (u))
        SELECT u, v, round(t0 * (1 + 15e-2 * pow(coalesce(q, 0) / capacity, 4)), 4) AS loaded_s FROM timed""",
    "point_in_polygon": _with("customer") + "SELECT id, " + _INSIDE.format(*map(_quad, _QUADS)) + " AS occluder FROM nodes",
    "apls": _with("supplier", _paths(), "damaged AS (SELECT * FROM ways WHERE (u + v) % 7 <> 0)", _paths("damaged", name="f"))
    + "SELECT round(avg(greatest(0, coalesce(1 - abs(f.d - d.d) / d.d, 0))), 6) AS apls FROM d LEFT JOIN f ON f.s = d.s AND f.v = d.v WHERE d.s < d.v AND d.d > 0",
    # Lines by their error term, one step a round.
    "rasterize": _with("supplier", _raster(0, "ignored"), """seg AS (SELECT row_number() OVER () AS i, * FROM (SELECT r0, c0, r1, c1 FROM lines UNION ALL SELECT r0, c0, r1 + c0 % 9 - 4, c1 + r1 % 7 - 3 FROM lines)),
        step(i, r, c, r1, c1, dr, dc, e) AS (SELECT i, r0, c0, r1, c1, abs(r1 - r0), abs(c1 - c0), abs(r1 - r0) - abs(c1 - c0) FROM seg
            UNION ALL SELECT i, CASE WHEN 2 * e > -dc THEN r + sign(r1 - r)::BIGINT ELSE r END, CASE WHEN 2 * e < dr THEN c + sign(c1 - c)::BIGINT ELSE c END, r1, c1, dr, dc,
                e - CASE WHEN 2 * e > -dc THEN dc ELSE 0 END + CASE WHEN 2 * e < dr THEN dr ELSE 0 END FROM step WHERE r <> r1 OR c <> c1)""")
    + """SELECT DISTINCT 't' AS tile, (r + dr)::INT AS row, (c + dc)::INT AS col FROM (SELECT r, c FROM step) p, (VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) o(dr, dc)
        WHERE r + dr BETWEEN 0 AND 99999 AND c + dc BETWEEN 0 AND 99999""",
    "dilate": _with("supplier", _raster(2, "px")) + "SELECT 't' AS tile, r::INT AS row, c::INT AS col FROM px",
    "erode": _with("supplier", _raster(2, "px"))
    + "SELECT 't' AS tile, a.r::INT AS row, a.c::INT AS col FROM px a WHERE (SELECT count(*) FROM px b WHERE abs(b.r - a.r) + abs(b.c - a.c) <= 1) = 5",
    "geo_match": _with("customer")
    + """, moved AS (SELECT id + 1000000 AS match, x + 2e-4 AS mx, y - 1e-4 AS my FROM nodes),
        met AS (SELECT id, match, 2 * 6371000::DOUBLE * asin(sqrt(pow(sin(radians(my - y) / 2), 2) + cos(radians(y)) * cos(radians(my)) * pow(sin(radians(mx - x) / 2), 2))) AS m FROM nodes JOIN moved ON abs(my - y) < 1e-3 AND abs(mx - x) < 1e-3)
        SELECT id, match, round(m, 3) AS distance_m FROM met WHERE m <= 40 QUALIFY row_number() OVER (PARTITION BY id ORDER BY m, match DESC) = 1""",
    "gap_candidates": _with("customer", """spots AS (SELECT id, x, y FROM nodes UNION ALL SELECT id + 10000000, x + 10232e-2 - CASE WHEN x + 10232e-2 >= 180 THEN 360 ELSE 0 END, y + 58 FROM nodes)""",
        "roads AS (SELECT u, v FROM ways UNION ALL SELECT u + 10000000, v + 10000000 FROM ways)")
    + """, stub AS (SELECT u AS id, min(v) AS o FROM roads GROUP BY 1 HAVING count(*) = 1), place AS (SELECT s.id, n.x, n.y, m.x AS ox, m.y AS oy FROM stub s JOIN spots n ON n.id = s.id JOIN spots m ON m.id = s.o),
        met AS (SELECT a.id AS a, b.id AS b, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, a.ox AS aox, a.oy AS aoy, b.ox AS box_, b.oy AS boy,
            2 * 6371000::DOUBLE * asin(sqrt(pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2))) AS m FROM place a JOIN place b ON a.id < b.id),
        v AS (SELECT *, (ax - aox) * cos(radians(aoy)) AS p1, ay - aoy AS p2, (bx - ax) * cos(radians(ay)) AS q1, by_ - ay AS q2, (bx - box_) * cos(radians(boy)) AS r1, by_ - boy AS r2, (ax - bx) * cos(radians(by_)) AS t1, ay - by_ AS t2 FROM met WHERE m <= 320)
        SELECT a, b, round(m, 3) AS gap_m, round(least((p1 * q1 + p2 * q2) / sqrt(p1 * p1 + p2 * p2) / sqrt(q1 * q1 + q2 * q2), (r1 * t1 + r2 * t2) / sqrt(r1 * r1 + r2 * r2) / sqrt(t1 * t1 + t2 * t2)), 6) AS straightness FROM v""",
    "skeletonize_step": _with("supplier", _raster(2, "px"))
    + """, off(i, dr, dc) AS (VALUES (0,-1,0),(1,-1,1),(2,0,1),(3,1,1),(4,1,0),(5,1,-1),(6,0,-1),(7,-1,-1)),
        near AS (SELECT p.r, p.c, list(q.r IS NOT NULL ORDER BY i) AS n FROM px p, off LEFT JOIN px q ON q.r = p.r + dr AND q.c = p.c + dc GROUP BY 1, 2),
        judged AS (SELECT r, c, n, len(list_filter(n, lambda b: b)) AS b, len(list_filter(range(8), lambda i: NOT n[i + 1] AND n[(i + 1) % 8 + 1])) AS a FROM near)
        SELECT 't' AS tile, r::INT AS row, c::INT AS col FROM judged WHERE NOT (b BETWEEN 2 AND 6 AND a = 1 AND NOT (n[1] AND n[3] AND n[5]) AND NOT (n[3] AND n[5] AND n[7]))""",
    "trace_degree": _with("supplier", _raster(0, "px"))
    + "SELECT k AS degree, count(*) AS pixels FROM (SELECT a.r, a.c, count(b.r) AS k FROM px a LEFT JOIN px b ON abs(b.r - a.r) <= 1 AND abs(b.c - a.c) <= 1 AND (b.r <> a.r OR b.c <> a.c) GROUP BY 1, 2) GROUP BY 1",
    "top_segments": _with("supplier", _paths(), _SIGMA) + f"SELECT e.u, e.v, round(coalesce(total, 0) / (n * (n - 1)), 8) AS betweenness FROM edges e LEFT JOIN ({_PAIRS}) p ON p.u = e.u AND p.v = e.v, side ORDER BY betweenness DESC, u, v LIMIT 5",
    "highest_ground": _with("customer") + "SELECT id, elevation, coalesce(amenity, 'none') AS amenity, row_number() OVER (PARTITION BY amenity ORDER BY elevation DESC, id) AS place FROM nodes QUALIFY place <= 3",
}
#: Steps of an attack on m edges: batches of m // 20 edges, one at least.
_STEPS = """size AS (SELECT count(*) AS m, greatest(1, count(*) // 20) AS k FROM edges), gone AS (SELECT u, v, row_number() OVER (ORDER BY ('0x' || substr(md5(u || '/' || v || '/7'), 1, 15))::BIGINT, u, v) AS place FROM edges),
    groups AS (SELECT unnest(range(((SELECT m FROM size) + (SELECT k FROM size) - 1) // (SELECT k FROM size) + 1)) AS g), alive AS (SELECT g, u, v FROM gone, groups, size WHERE place > g * k UNION ALL SELECT g, v, u FROM gone, groups, size WHERE place > g * k)"""
ORACLE_SQL["robustness_random"] = _with("supplier", _STEPS, _scenario_components("alive", "SELECT g, id FROM groups, nodes")) + """SELECT g AS step, round(least(g * k, m)::DOUBLE / m, 6) AS fraction, round(max(n)::DOUBLE / (SELECT count(*) FROM nodes), 6) AS lcc
    FROM (SELECT g, component, count(*) AS n FROM cc GROUP BY 1, 2), size GROUP BY g, k, m"""
ORACLE_SQL["restoration_priority"] = (
    _flood(f"(0, {LEVEL}::DOUBLE)")
    + f""", own AS (SELECT id, component FROM cc WHERE g = 0), weight AS (SELECT component, count(*) AS n FROM own GROUP BY 1),
    between AS (SELECT l.u, l.v, a.component AS cu, b.component AS cv, wa.n AS nu, wb.n AS nv FROM low l JOIN own a ON a.id = l.u JOIN own b ON b.id = l.v
        JOIN weight wa ON wa.component = a.component JOIN weight wb ON wb.component = b.component WHERE low < {LEVEL} AND a.component <> b.component),
    pick(k, reached, u, v, gain) AS (SELECT 0, (SELECT list(component) FROM served WHERE g = 0), 0::BIGINT, 0::BIGINT, 0::BIGINT
        UNION ALL SELECT k + 1, list_append(reached, m.opened), -m.nu, -m.nv, m.gain FROM (SELECT k, reached, max(struct_pack(gain := CASE WHEN list_contains(reached, cu) THEN b.nv ELSE b.nu END, nu := -b.u, nv := -b.v, opened := CASE WHEN list_contains(reached, cu) THEN cv ELSE cu END)) AS m
            FROM pick, between b WHERE k < 5 AND list_contains(reached, cu) <> list_contains(reached, cv) GROUP BY k, reached))
    SELECT k AS rank, u, v, gain AS restores FROM pick WHERE k > 0"""
)
ORACLE_SQL["streamed_betweenness"] = ORACLE_SQL["sampled_betweenness"]

ORACLE_SQL["analysis_summary"] = (
    _BRIDGES
    + ", hub AS (SELECT u AS g FROM ways GROUP BY 1 HAVING count(*) > 1), alive2 AS (SELECT g, u, v FROM hub, ways WHERE u <> g AND v <> g), "
    + _scenario_components("alive2", "SELECT g, id FROM hub, nodes WHERE id <> g", name="c2")
    + ", "
    + _components(name="c3")
    + """, points AS (SELECT e.u FROM ways e JOIN c2 ON c2.g = e.u AND c2.id = e.v GROUP BY 1 HAVING count(DISTINCT component) > 1), part AS (SELECT component, count(*) AS n FROM c3 GROUP BY 1)
    SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM part) AS connected_components, (SELECT max(n) FROM part) AS largest_component,
        (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM points) AS articulation_points, (SELECT count(*) FROM bridge) AS bridges"""
)
_EXACT = f"exact AS (SELECT e.u, e.v, coalesce(total, 0) / (n * (n - 1)) AS b FROM edges e LEFT JOIN ({_PAIRS}) p ON p.u = e.u AND p.v = e.v, side)"
ORACLE_SQL["estimate_error"] = (
    _with("supplier", _paths(), _SIGMA, _EXACT)
    + ", drawn AS (SELECT user_id % n AS s, count(*) AS k FROM events, side GROUP BY 1), each AS (SELECT a.s, least(e.u, e.v) AS u, greatest(e.u, e.v) AS v, sum(su.n * sv.n / st.n) AS total "
    + _PAIRS[_PAIRS.index("FROM ways e") :].replace("GROUP BY ALL", "GROUP BY ALL)")
    + """, guess AS (SELECT e.u, e.v, coalesce(sum(k * total), 0) / (SELECT sum(k) FROM drawn) / (SELECT n - 1 FROM side) AS a
        FROM edges e LEFT JOIN each ON each.u = e.u AND each.v = e.v LEFT JOIN drawn ON drawn.s = each.s GROUP BY 1, 2)
    SELECT round(max(abs(a - b)), 7) AS worst, round(avg(abs(a - b)), 7) AS mean, count(*) AS shared FROM guess JOIN exact USING (u, v)"""
)
ORACLE_SQL["zone_capacity"] = (
    ORACLE_SQL["zones"].replace("SELECT 'west' AS zone", ", z AS (SELECT 'west' AS zone")
    + ") SELECT zone, coalesce(sum(capacity), 0) + 1 AS capacity FROM z LEFT JOIN arcs ON arcs.u = z.id GROUP BY 1"
)
ORACLE_SQL["saving_projection"] = f"SELECT batch, samples, greatest(1, round(100000 / samples))::BIGINT AS saving FROM ({ORACLE_SQL['progressive_epsilon']})"


def _metres(ax: str, ay: str, bx: str, by: str) -> str:
    return f"2 * 6371000::DOUBLE * asin(sqrt(pow(sin(radians({by} - {ay}) / 2), 2) + cos(radians({ay})) * cos(radians({by})) * pow(sin(radians({bx} - {ax}) / 2), 2)))"


ORACLE_SQL["edge_path_length"] = _with("customer") + f"""SELECT u, v, round({_metres('ax', 'ay', 'mx', 'my')} + {_metres('mx', 'my', 'bx', '"by"')}, 3) AS length_m
    FROM (SELECT u, v, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS "by", (a.x + b.x) / 2 AS mx, (a.y + b.y) / 2 + 5e-4 AS my FROM edges JOIN nodes a ON a.id = u JOIN nodes b ON b.id = v)"""
