"""The queries of queries.py in DuckDB SQL, as chains of common table expressions."""

from __future__ import annotations

import re

ONE, NORMAL = 1 << 24, 1_000_000
DIM = 8


def _cte(name: str, body: str) -> str:
    return f"{name} AS ({body})"


POINTS = """SELECT (l_suppkey % 3)::INT AS seg, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END::INT AS level,
 (((l_partkey * 7 + l_suppkey) % 97) * 70 - 3300 + (l_suppkey % 3) * 4000)::BIGINT AS x,
 (((l_orderkey * 11 + l_linenumber) % 89) * 70 - 3100)::BIGINT AS y, ((l_quantity - 25) * 2)::BIGINT AS z,
 CASE WHEN l_returnflag <> 'R' THEN round((l_discount - 0.05::DOUBLE) * 1000)::BIGINT ELSE 0 END AS nx,
 CASE WHEN l_returnflag <> 'R' THEN round((l_tax - 0.04::DOUBLE) * 1000)::BIGINT ELSE 0 END AS ny,
 CASE WHEN l_returnflag <> 'R' THEN 1000 ELSE 0 END::BIGINT AS nz,
 (l_quantity * 5)::BIGINT AS r, (l_linenumber * 30)::BIGINT AS g, round(l_discount * 1000)::BIGINT AS b,
 (row_number() OVER (PARTITION BY l_suppkey % 3, l_linestatus = 'F' ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1)::BIGINT AS ord
 FROM lineitem"""
SUMS = """SELECT seg, level, floor(x / 100.0)::BIGINT AS kx, floor(y / 100.0)::BIGINT AS ky, floor(z / 100.0)::BIGINT AS kz,
 count(*)::BIGINT AS n, sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy, sum(z)::BIGINT AS sz, sum(r)::BIGINT AS sr, sum(g)::BIGINT AS sg, sum(b)::BIGINT AS sb,
 sum(CASE WHEN ok THEN 1 ELSE 0 END)::BIGINT AS nv, sum(CASE WHEN ok THEN nx ELSE 0 END)::BIGINT AS snx, sum(CASE WHEN ok THEN ny ELSE 0 END)::BIGINT AS sny, sum(CASE WHEN ok THEN nz ELSE 0 END)::BIGINT AS snz
 FROM (SELECT *, nx * nx + ny * ny + nz * nz BETWEEN 250000 AND 2250000 AS ok FROM points) GROUP BY ALL"""


def _bins(trust: str) -> str:
    return f"""SELECT seg, level, kx, ky, kz, n, round(sx / n)::BIGINT AS px, round(sy / n)::BIGINT AS py, round(sz / n)::BIGINT AS pz,
 CASE WHEN fixed THEN round(snx / len * {NORMAL})::BIGINT END AS nx, CASE WHEN fixed THEN round(sny / len * {NORMAL})::BIGINT END AS ny, CASE WHEN fixed THEN round(snz / len * {NORMAL})::BIGINT END AS nz,
 round(sr / n)::BIGINT AS r, round(sg / n)::BIGINT AS g, round(sb / n)::BIGINT AS b, fixed
 FROM (SELECT *, {trust} AND nv > 0 AND len > nv * 300.0::DOUBLE AS fixed FROM (SELECT *, sqrt((snx * snx + sny * sny + snz * snz)::DOUBLE) AS len FROM sums))"""


MOMENTS = """SELECT a.seg, a.level, a.kx, a.ky, a.kz, any_value(a.n) AS n, any_value(a.px) AS px, any_value(a.py) AS py, any_value(a.pz) AS pz, any_value(a.nx) AS nx, any_value(a.ny) AS ny, any_value(a.nz) AS nz,
 any_value(a.r) AS r, any_value(a.g) AS g, any_value(a.b) AS b, any_value(a.fixed) AS fixed, count(*)::BIGINT AS m,
 sum(c.px - a.px)::BIGINT AS mx, sum(c.py - a.py)::BIGINT AS my, sum(c.pz - a.pz)::BIGINT AS mz,
 sum((c.px - a.px) * (c.px - a.px))::BIGINT AS mxx, sum((c.py - a.py) * (c.py - a.py))::BIGINT AS myy, sum((c.pz - a.pz) * (c.pz - a.pz))::BIGINT AS mzz,
 sum((c.px - a.px) * (c.py - a.py))::BIGINT AS mxy, sum((c.px - a.px) * (c.pz - a.pz))::BIGINT AS mxz, sum((c.py - a.py) * (c.pz - a.pz))::BIGINT AS myz
 FROM (SELECT *, unnest(range(-2, 3)) AS dx FROM bins) a0, LATERAL (SELECT a0.*) a
 JOIN (SELECT *, kx AS jx FROM bins) c ON c.seg = a.seg AND c.level = a.level AND c.jx = a.kx + a.dx AND c.ky BETWEEN a.ky - 2 AND a.ky + 2 AND c.kz BETWEEN a.kz - 2 AND a.kz + 2
 GROUP BY a.seg, a.level, a.kx, a.ky, a.kz"""
MOMENTS = MOMENTS.replace("a0, LATERAL (SELECT a0.*) a\n", "a\n")
_KINDS = ("xx", "yy", "zz", "xy", "xz", "yz")
_ADJ = {"xx": "{p}yy * {p}zz - {p}yz * {p}yz", "yy": "{p}xx * {p}zz - {p}xz * {p}xz", "zz": "{p}xx * {p}yy - {p}xy * {p}xy", "xy": "{p}xz * {p}yz - {p}xy * {p}zz", "xz": "{p}xy * {p}yz - {p}xz * {p}yy", "yz": "{p}xy * {p}xz - {p}yz * {p}xx"}


def _eigen() -> str:
    """Least eigenvectors of covariances, step by step: e1..e3 of the polynomial, Laguerre's steps, the adjugate, its powers."""
    adj = {k: v.format(p="a") for k, v in _ADJ.items()}
    q = f"""SELECT *, axx + ayy + azz AS e1, ({adj['xx']}) + ({adj['yy']}) + ({adj['zz']}) AS e2, axx * ({adj['xx']}) + axy * ({adj['xy']}) + axz * ({adj['xz']}) AS e3, 0.0::DOUBLE AS l FROM (
 SELECT *, {', '.join(f'{k} / t AS a{k}' for k in _KINDS)} FROM (SELECT *, CASE WHEN xx + yy + zz > 0 THEN xx + yy + zz ELSE 1.0::DOUBLE END AS t FROM (
 SELECT *, mxx / m - (mx / m) * (mx / m) AS xx, myy / m - (my / m) * (my / m) AS yy, mzz / m - (mz / m) * (mz / m) AS zz,
 mxy / m - (mx / m) * (my / m) AS xy, mxz / m - (mx / m) * (mz / m) AS xz, myz / m - (my / m) * (mz / m) AS yz FROM moments WHERE fixed OR m >= 6)))"""
    for _ in range(6):
        q = f"SELECT *, ((e1 - l) * l - e2) * l + e3 AS p, (3 * l - 2 * e1) * l + e2 AS d, 2 * e1 - 6 * l AS c FROM ({q})"
        q = f"SELECT *, 4 * d * d - 6 * p * c AS h FROM ({q})"
        q = f"SELECT * EXCLUDE (l, p, d, c, h), l + greatest(CASE WHEN h >= 0 AND d + sqrt(greatest(h, 0.0::DOUBLE)) <> 0 THEN 3 * p / (d + sqrt(greatest(h, 0.0::DOUBLE))) ELSE 0.0::DOUBLE END, 0.0::DOUBLE) AS l FROM ({q})"
    q = f"SELECT *, {', '.join(f'a{k} - (l - 1e-7::DOUBLE) AS s{k}' for k in _KINDS[:3])}, {', '.join(f'a{k} AS s{k}' for k in _KINDS[3:])} FROM ({q})"
    q = f"SELECT *, {', '.join(f'{v.format(p="s")} AS j{k}' for k, v in _ADJ.items())} FROM ({q})"
    q = f"SELECT * EXCLUDE ({', '.join(f'j{k}' for k in _KINDS)}), {', '.join(f'j{k} / (jxx + jyy + jzz) AS b{k}' for k in _KINDS)} FROM ({q})"
    side = lambda i, j: "b" + "".join(sorted(i + j))
    for _ in range(5):
        square = ", ".join(f"{' + '.join(f'{side(k[0], o)} * {side(o, k[1])}' for o in 'xyz')} AS n{k}" for k in _KINDS)
        q = f"SELECT * EXCLUDE ({', '.join(f'n{k}' for k in _KINDS)}), {', '.join(f'n{k} AS b{k}' for k in _KINDS)} FROM (SELECT * EXCLUDE ({', '.join(f'b{k}' for k in _KINDS)}), {square} FROM ({q}))"
    pick = ", ".join(f"CASE WHEN bzz = greatest(bxx, byy, bzz) THEN {side(k, 'z')} WHEN byy = greatest(bxx, byy, bzz) THEN {side(k, 'y')} ELSE {side(k, 'x')} END AS v{k}" for k in "xyz")
    return f"SELECT *, CASE WHEN vz < 0 THEN -1 ELSE 1 END * sqrt(vx * vx + vy * vy + vz * vz) AS nn FROM (SELECT *, {pick} FROM ({q}))"


SOLVED = _eigen()
ORIENTED = f"""SELECT seg, level, kx, ky, kz, n, px, py, pz, {', '.join(f'coalesce(n{k}, round(v{k} / nn * {NORMAL})::BIGINT) AS n{k}' for k in 'xyz')}, r, g, b, fixed FROM solved"""


def _splat(source: str) -> str:
    return f"""SELECT layer, gx, gy, gz, w * d AS wd, w, w * r AS wr, w * g AS wg, w * b AS wb FROM (
 SELECT *, round(exp(-q / 80000.0::DOUBLE) * {ONE})::BIGINT AS w, round((nx * (gx * 200 - px) + ny * (gy * 200 - py) + nz * (gz * 200 - pz)) / 1000.0::DOUBLE)::BIGINT AS d FROM (
 SELECT *, (gx * 200 - px) * (gx * 200 - px) + (gy * 200 - py) * (gy * 200 - py) + (gz * 200 - pz) * (gz * 200 - pz) AS q FROM (
 SELECT *, unnest(range(ceil((pz - 400) / 200.0::DOUBLE)::BIGINT, floor((pz + 400) / 200.0::DOUBLE)::BIGINT + 1)) AS gz FROM (
 SELECT *, unnest(range(ceil((py - 400) / 200.0::DOUBLE)::BIGINT, floor((py + 400) / 200.0::DOUBLE)::BIGINT + 1)) AS gy FROM (
 SELECT *, CASE WHEN level = 1 THEN -1 ELSE seg END AS layer, unnest(range(ceil((px - 400) / 200.0::DOUBLE)::BIGINT, floor((px + 400) / 200.0::DOUBLE)::BIGINT + 1)) AS gx FROM {source}))) ) WHERE q <= 160000)"""


def _field(rows: str) -> str:
    return f"SELECT layer, gx, gy, gz, sum(wd)::BIGINT AS wd, sum(w)::BIGINT AS w, sum(wr)::BIGINT AS wr, sum(wg)::BIGINT AS wg, sum(wb)::BIGINT AS wb FROM ({rows}) GROUP BY ALL"


def _summed(rows: str) -> str:
    return f"SELECT gx, gy, gz, sum(wd)::BIGINT AS wd, sum(w)::BIGINT AS w, sum(wr)::BIGINT AS wr, sum(wg)::BIGINT AS wg, sum(wb)::BIGINT AS wb FROM {rows} GROUP BY ALL"


def _seen(field: str) -> str:
    return f"SELECT *, wd / w AS d FROM ({_summed(field)}) WHERE w >= {ONE // 2}"


CORNERS = [(i & 1, i >> 1 & 1, i >> 2 & 1) for i in range(8)]
EDGES = [(a, a | 1 << k) for k in range(3) for a in range(8) if not a >> k & 1]


def _vertices(seen: str) -> str:
    parts = " UNION ALL ".join(f"SELECT gx - {x} AS cx, gy - {y} AS cy, gz - {z} AS cz, {i} AS k, d, wr / w AS r, wg / w AS g, wb / w AS b FROM {seen}" for i, (x, y, z) in enumerate(CORNERS))
    pick = ", ".join(f"max(CASE WHEN k = {i} THEN {c} END) AS {c}{i}" for i in range(8) for c in "drgb")
    cells = f"SELECT cx, cy, cz, {pick} FROM ({parts}) GROUP BY cx, cy, cz HAVING count(*) = 8 AND sum(CASE WHEN d < 0 THEN 1 ELSE 0 END) BETWEEN 1 AND 7"
    ts = ", ".join(f"CASE WHEN (d{a} < 0) <> (d{b} < 0) THEN d{a} / (d{a} - d{b}) END AS t{i}" for i, (a, b) in enumerate(EDGES))
    count = " + ".join(f"CASE WHEN t{i} IS NOT NULL THEN 1 ELSE 0 END" for i in range(12))

    def mean(at: list[str]) -> str:
        total = "0.0::DOUBLE"
        for i, (a, b) in enumerate(EDGES):
            total = f"({total} + CASE WHEN t{i} IS NOT NULL THEN {at[a]} + t{i} * ({at[b]} - {at[a]}) ELSE 0.0::DOUBLE END)"
        return f"{total} / cnt"

    pos = ", ".join(f"round((c{n} + {mean([f'{c[k]}.0::DOUBLE' for c in CORNERS])}) * 200000.0::DOUBLE)::BIGINT AS {n}" for k, n in enumerate("xyz"))
    col = ", ".join(f"least(greatest(round({mean([f'{c}{i}' for i in range(8)])}), 0.0::DOUBLE), 255.0::DOUBLE)::INT AS {c}" for c in "rgb")
    return f"SELECT cx, cy, cz, {pos}, {col} FROM (SELECT *, {count} AS cnt FROM (SELECT *, {ts} FROM ({cells})))"


def _edges(seen: str) -> str:
    one = [f"SELECT a.gx, a.gy, a.gz, {k} AS axis, NOT (a.d < 0) AS flip FROM {seen} a JOIN {seen} b ON b.gx = a.gx + {int(k == 0)} AND b.gy = a.gy + {int(k == 1)} AND b.gz = a.gz + {int(k == 2)} WHERE (a.d < 0) <> (b.d < 0)" for k in range(3)]
    return " UNION ALL ".join(one)


def _quads(edges: str, verts: str) -> str:
    out = []
    for k in range(3):
        i, j = (k + 1) % 3, (k + 2) % 3
        joins, names = "", []
        for n, (di, dj) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1))):
            o = [0, 0, 0]
            o[i], o[j] = di, dj
            joins += f" JOIN {verts} v{n} ON v{n}.cx = e.gx - {o[0]} AND v{n}.cy = e.gy - {o[1]} AND v{n}.cz = e.gz - {o[2]}"
        for n, (a, b) in enumerate(((0, 0), (1, 3), (2, 2), (3, 1))):
            names += [f"CASE WHEN flip THEN v{b}.{c} ELSE v{a}.{c} END AS q{n}{c[-1] if c[0] == 'c' else '_' + c}" for c in ("cx", "cy", "cz", "x", "y", "z", "r", "g", "b")]
        out.append(f"SELECT floor(gx / {DIM}.0)::BIGINT AS bx, floor(gy / {DIM}.0)::BIGINT AS by, floor(gz / {DIM}.0)::BIGINT AS bz, gx, gy, gz, axis, {', '.join(names)} FROM {edges} e{joins} WHERE axis = {k}")
    return " UNION ALL ".join(out)


def _used(quads: str) -> str:
    each = " UNION ALL ".join(f"SELECT bx, by, bz, q{n}x AS cx, q{n}y AS cy, q{n}z AS cz, q{n}_x AS x, q{n}_y AS y, q{n}_z AS z, q{n}_r AS r, q{n}_g AS g, q{n}_b AS b FROM {quads}" for n in range(4))
    return f"SELECT *, (row_number() OVER (PARTITION BY bx, by, bz ORDER BY cz, cy, cx) - 1)::INT AS idx FROM (SELECT DISTINCT * FROM ({each}))"


def _digests(quads: str, used: str) -> str:
    pos = "string_agg(concat_ws(',', x, y, z), ',' ORDER BY idx)"
    col = "string_agg(concat_ws(',', r, g, b), ',' ORDER BY idx)"
    joins = " ".join(f"JOIN {used} u{n} ON u{n}.bx = q.bx AND u{n}.by = q.by AND u{n}.bz = q.bz AND u{n}.cx = q.q{n}x AND u{n}.cy = q.q{n}y AND u{n}.cz = q.q{n}z" for n in range(4))
    tri = f"SELECT q.bx, q.by, q.bz, string_agg(concat_ws(',', u0.idx, u1.idx, u2.idx, u0.idx, u2.idx, u3.idx), ',' ORDER BY q.gz, q.gy, q.gx, q.axis) AS t FROM {quads} q {joins} GROUP BY q.bx, q.by, q.bz"
    return f"SELECT v.bx, v.by, v.bz, md5(concat_ws(';', p, c, t)) AS digest FROM (SELECT bx, by, bz, {pos} AS p, {col} AS c FROM {used} GROUP BY bx, by, bz) v JOIN ({tri}) t ON t.bx = v.bx AND t.by = v.by AND t.bz = v.bz"


def _halo(voxels: str, upper: bool = False) -> str:
    side = ", ".join(f"CASE WHEN g{a} = b{a} * {DIM} THEN -1 WHEN g{a} = b{a} * {DIM} + {DIM - 1} THEN {0 if upper else 1} ELSE 0 END AS s{a}" for a in "xyz")
    grid = "(SELECT unnest([-1, 0, 1]) AS ox), (SELECT unnest([-1, 0, 1]) AS oy), (SELECT unnest([-1, 0, 1]) AS oz)"
    return f"""SELECT bx + ox AS bx, by + oy AS by, bz + oz AS bz, max(ox = 0 AND oy = 0 AND oz = 0) AS direct FROM (
 SELECT DISTINCT bx, by, bz, {side} FROM (SELECT DISTINCT gx, gy, gz, floor(gx / {DIM}.0)::BIGINT AS bx, floor(gy / {DIM}.0)::BIGINT AS by, floor(gz / {DIM}.0)::BIGINT AS bz FROM {voxels})), {grid}
 WHERE ox IN (0, sx) AND oy IN (0, sy) AND oz IN (0, sz) AND NOT (ox = 1 AND oy = 1 AND oz = 1) GROUP BY ALL"""


def _with(ctes: list[tuple[str, str]], select: str, recursive: bool = False) -> str:
    sql = f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(_cte(n, b) for n, b in ctes) + f"\n{select}"
    return re.sub(r"\bby\b", '"by"', sql)  # the column, not the keyword


P = [("points", POINTS)]
S = [*P, ("sums", SUMS)]
B = [*S, ("bins", _bins("level = 1"))]
BN = [*S, ("bins", _bins("false"))]
E = [*B, ("moments", MOMENTS), ("solved", SOLVED), ("oriented", ORIENTED)]
FIELD = [*E, ("field", _field(_splat("oriented")))]
SEEN = [*FIELD, ("seen", _seen("field"))]
VERTS = [*SEEN, ("verts", _vertices("seen")), ("edges", _edges("seen"))]
QUADS = [*VERTS, ("quads", _quads("edges", "verts"))]
USED = [*QUADS, ("used", _used("quads"))]
HC = "SELECT CASE WHEN level = 1 THEN -1 ELSE seg END AS layer, floor(px / 200.0)::BIGINT AS cx, floor(py / 200.0)::BIGINT AS cy, sum(pz)::BIGINT AS wz, count(*)::BIGINT AS w, sum(r)::BIGINT AS wr, sum(g)::BIGINT AS wg, sum(b)::BIGINT AS wb FROM bins GROUP BY ALL"
HQ = [*BN, ("hc", HC), ("hs", "SELECT cx, cy, sum(wz)::BIGINT / sum(w)::BIGINT AS z FROM hc GROUP BY ALL HAVING sum(w) >= 0.5"), ("hq", "SELECT a.cx, a.cy, a.z AS z00, b.z AS z10, c.z AS z11, d.z AS z01 FROM hs a JOIN hs b ON b.cx = a.cx + 1 AND b.cy = a.cy JOIN hs c ON c.cx = a.cx + 1 AND c.cy = a.cy + 1 JOIN hs d ON d.cx = a.cx AND d.cy = a.cy + 1 WHERE greatest(a.z, b.z, c.z, d.z) - least(a.z, b.z, c.z, d.z) <= 800")]
#: Height cells with colours, and the quads of tiles in the form of the table quads.
HCELL = "SELECT cx, cy, 0::BIGINT AS cz, cx * 200000 + 100000 AS x, cy * 200000 + 100000 AS y, round(z * 1000)::BIGINT AS z, h, " + ", ".join(f"least(greatest(round({c}), 0.0::DOUBLE), 255.0::DOUBLE)::INT AS {c}" for c in "rgb") + " FROM (SELECT cx, cy, sum(wz)::BIGINT / sum(w)::BIGINT AS z, sum(wz)::BIGINT / sum(w)::BIGINT AS h, " + ", ".join(f"sum(w{c})::BIGINT / sum(w)::BIGINT AS {c}" for c in "rgb") + " FROM hc GROUP BY cx, cy HAVING sum(w) >= 0.5)"
HFACES = "SELECT floor(v0.cx / 8.0)::BIGINT AS bx, floor(v0.cy / 8.0)::BIGINT AS by, 0::BIGINT AS bz, v0.cx AS gx, v0.cy AS gy, 0::BIGINT AS gz, 0 AS axis, " + ", ".join(f"v{n}.{c} AS q{n}{c[-1] if c[0] == 'c' else '_' + c}" for n in range(4) for c in ("cx", "cy", "cz", "x", "y", "z", "r", "g", "b")) + " FROM hcell v0 " + " ".join(f"JOIN hcell v{n} ON v{n}.cx = v0.cx + {dx} AND v{n}.cy = v0.cy + {dy}" for n, dx, dy in ((1, 1, 0), (2, 1, 1), (3, 0, 1))) + " WHERE greatest(v0.h, v1.h, v2.h, v3.h) - least(v0.h, v1.h, v2.h, v3.h) <= 800"
HF = [*BN, ("hc", HC), ("hcell", HCELL), ("hfaces", HFACES)]
_tri = lambda vs, half: "SELECT floor(cx / 8.0)::BIGINT AS bx, floor(cy / 8.0)::BIGINT AS by, cx, cy, " + f"{half} AS half, " + ", ".join(f"((cx + {dx}) * 200 + 100) * 1000 AS x{i}, ((cy + {dy}) * 200 + 100) * 1000 AS y{i}, round({z} * 1000)::BIGINT AS z{i}" for i, (dx, dy, z) in enumerate(vs)) + " FROM hq"
_a, _b, _c, _d = (0, 0, "z00"), (1, 0, "z10"), (1, 1, "z11"), (0, 1, "z01")


def _branch(tag: str, where: str) -> list[tuple[str, str]]:
    """Field, mesh and digests of the oriented bins that `where` keeps."""
    n = lambda x: f"{x}_{tag}"
    return [(n("rows"), f"SELECT * FROM oriented WHERE {where}"), (n("field"), _field(_splat(n("rows")))), (n("seen"), _seen(n("field"))), (n("verts"), _vertices(n("seen"))), (n("edges"), _edges(n("seen"))), (n("quads"), _quads(n("edges"), n("verts"))), (n("used"), _used(n("quads"))), (n("dig"), _digests(n("quads"), n("used")))]


STATES = [*E, *_branch("a", "(seg = 0 AND level = 1) OR (seg <> 0 AND level = 0)"), *_branch("b", "(seg < 2 AND level = 1) OR (seg = 2 AND level = 0)")]
NEED = "NOT (fixed OR abs(nz) >= 700000.0)"


def _graph(bins: str) -> str:
    dot = "(s.nx / 1000000.0::DOUBLE) * (t.nx / 1000000.0::DOUBLE) + (s.ny / 1000000.0::DOUBLE) * (t.ny / 1000000.0::DOUBLE) + (s.nz / 1000000.0::DOUBLE) * (t.nz / 1000000.0::DOUBLE)"
    ne = "((s.nx / 1000000.0::DOUBLE) * (t.px - s.px) + (s.ny / 1000000.0::DOUBLE) * (t.py - s.py) + (s.nz / 1000000.0::DOUBLE) * (t.pz - s.pz))"
    me = "((t.nx / 1000000.0::DOUBLE) * (t.px - s.px) + (t.ny / 1000000.0::DOUBLE) * (t.py - s.py) + (t.nz / 1000000.0::DOUBLE) * (t.pz - s.pz))"
    e2 = "((t.px - s.px) * (t.px - s.px) + (t.py - s.py) * (t.py - s.py) + (t.pz - s.pz) * (t.pz - s.pz))"
    return f"""SELECT s.seg, s.level, s.kx AS skx, s.ky AS sky, s.kz AS skz, t.kx AS tkx, t.ky AS tky, t.kz AS tkz, {NEED.replace('fixed', 't.fixed').replace('nz', 't.nz')} AS dst_need,
 round(CASE WHEN abs({dot}) < 0.3::DOUBLE AND {e2} > 0 THEN {dot} - 2 * {ne} * {me} / {e2} ELSE {dot} END, 6) AS v
 FROM (SELECT *, unnest(range(-2, 3)) AS dx FROM {bins} WHERE {NEED}) s JOIN {bins} t ON t.seg = s.seg AND t.level = s.level AND t.kx = s.kx + s.dx AND t.ky BETWEEN s.ky - 2 AND s.ky + 2 AND t.kz BETWEEN s.kz - 2 AND s.kz + 2 AND NOT (t.kx = s.kx AND t.ky = s.ky AND t.kz = s.kz)"""


GRAPH = [*E, ("tilt", "SELECT * REPLACE (CASE WHEN kx % 5 <> 0 THEN least(nz, 699999) ELSE nz END AS nz, fixed AND kx % 5 = 0 AS fixed) FROM oriented"), ("graph", _graph("tilt"))]
#: All bins undecided; labels sink to the least cell of the component, round after round.
LOOSE = [*E, ("loose", "SELECT * REPLACE (least(nz, 699999) AS nz, false AS fixed) FROM oriented"), ("graph", _graph("loose")),
         ("labels(seg, level, kx, ky, kz, label) USING KEY (seg, level, kx, ky, kz)", """SELECT seg, level, kx, ky, kz, {'kx': kx, 'ky': ky, 'kz': kz} FROM loose
 UNION SELECT g.seg, g.level, g.tkx, g.tky, g.tkz, min(l.label) FROM labels l JOIN graph g ON g.seg = l.seg AND g.level = l.level AND g.skx = l.kx AND g.sky = l.ky AND g.skz = l.kz
 JOIN recurring.labels r ON r.seg = g.seg AND r.level = g.level AND r.kx = g.tkx AND r.ky = g.tky AND r.kz = g.tkz WHERE l.label < r.label GROUP BY ALL""")]
AGREE = [*E, ("base", f"SELECT gx, gy, gz, wd / w / 1000.0::DOUBLE AS d FROM ({_field(_splat('(SELECT * FROM oriented WHERE level = 1)'))}) WHERE w >= {ONE // 2}"),
         ("asked", "SELECT seg, level, kx, ky, kz, s, floor(ux)::BIGINT + x AS gx, floor(uy)::BIGINT + y AS gy, floor(uz)::BIGINT + z AS gz, 1.0::DOUBLE * (CASE WHEN x = 1 THEN ux - floor(ux) ELSE 1.0::DOUBLE - (ux - floor(ux)) END) * (CASE WHEN y = 1 THEN uy - floor(uy) ELSE 1.0::DOUBLE - (uy - floor(uy)) END) * (CASE WHEN z = 1 THEN uz - floor(uz) ELSE 1.0::DOUBLE - (uz - floor(uz)) END) AS wt FROM (SELECT *, "
          + ", ".join(f"(p{a} + s * 300.0::DOUBLE * (n{a} / 1000000.0::DOUBLE)) / 200.0::DOUBLE AS u{a}" for a in "xyz")
          + " FROM (SELECT * FROM oriented WHERE level = 0 AND NOT fixed), (SELECT unnest([-1.0::DOUBLE, 1.0::DOUBLE]) AS s), (SELECT unnest([0, 1]) AS x), (SELECT unnest([0, 1]) AS y), (SELECT unnest([0, 1]) AS z))"),
         ("agree", "SELECT seg, level, kx, ky, kz, round(least(greatest(rise / (600.0::DOUBLE * 1000000.0::DOUBLE), -1.0::DOUBLE), 1.0::DOUBLE), 6) AS a FROM (SELECT seg, level, kx, ky, kz, sum(round(wt * d * s * 1000000.0::DOUBLE)::BIGINT)::BIGINT AS rise FROM asked JOIN base USING (gx, gy, gz) GROUP BY seg, level, kx, ky, kz HAVING count(*) = 16)")]
QUAD_COLUMNS = ", ".join(["bx", "by", "bz", "gx", "gy", "gz", "axis", *(f"q{k}{a}" for k in range(4) for a in "xyz")])
MM = "SELECT DISTINCT round(x / 1000.0::DOUBLE)::BIGINT AS x, round(y / 1000.0::DOUBLE)::BIGINT AS y, round(z / 1000.0::DOUBLE)::BIGINT AS z FROM used"
MESH_STATS = "SELECT u.bx, u.by, u.bz, u.n AS vertices, q.n AS triangles FROM (SELECT bx, by, bz, count(*)::BIGINT AS n FROM used GROUP BY ALL) u JOIN (SELECT bx, by, bz, (2 * count(*))::BIGINT AS n FROM quads GROUP BY ALL) q ON q.bx = u.bx AND q.by = u.by AND q.bz = u.bz"
DIRTY1 = [*E, *((f"f{k}", _field(_splat(f"(SELECT * FROM oriented WHERE seg = 1 AND level = {k})"))) for k in (0, 1)), ("dirty", f"SELECT bx, by, bz, max(direct) AS direct FROM ({_halo('f0')} UNION ALL {_halo('f1')}) GROUP BY ALL")]


def _lists() -> str:
    out = "oriented"
    for a in "xyz":
        out = f"(SELECT *, unnest(range(floor(ceil((p{a} - 400) / 200.0::DOUBLE) / 8.0::DOUBLE)::BIGINT, floor(floor((p{a} + 400) / 200.0::DOUBLE) / 8.0::DOUBLE)::BIGINT + 1)) AS b{a} FROM {out})"
    return f"SELECT bx, by, bz, count(*)::BIGINT AS bins, md5(string_agg(concat_ws(',', seg, level, kx, ky, kz), ';' ORDER BY seg, level, kx, ky, kz)) AS list FROM {out} GROUP BY bx, by, bz"


ORACLES: dict[str, str] = {
    "point_view": _with(P, "SELECT * FROM points"),
    "finite_filter": _with(P, "SELECT seg, level, count(*)::BIGINT AS n, sum(x)::BIGINT AS sx FROM points WHERE x % 7 <> 0 AND x % 11 <> 0 GROUP BY ALL"),
    "stride_sample": _with(P, "SELECT * FROM points WHERE ord % 4 = 0"),
    "synthetic_preview": _with(P, "SELECT * REPLACE (0::INT AS level, 0::BIGINT AS nx, 0::BIGINT AS ny, 0::BIGINT AS nz) FROM points WHERE level = 1 AND ord % 4 = 0"),
    "valid_normals": _with(P, "SELECT seg, level, count(*)::BIGINT AS n, sum(nx)::BIGINT AS snx FROM points WHERE nx * nx + ny * ny + nz * nz BETWEEN 250000 AND 2250000 GROUP BY ALL"),
    "segment_limit": _with(P, "SELECT seg, level, count(*)::BIGINT AS n FROM points WHERE seg < 2 GROUP BY ALL"),
    "bin_aggregate": _with(S, "SELECT * FROM sums"),
    "bin_trusted_normals": _with(B, "SELECT * FROM bins"),
    "bin_rank": _with(S, "SELECT seg, level, kx, ky, kz, (row_number() OVER (PARTITION BY seg, level ORDER BY kx, ky, kz) - 1)::INT AS idx FROM sums"),
    "neighbor_moments": _with(E[:4], "SELECT seg, level, kx, ky, kz, m, mx, my, mz, mxx, myy, mzz, mxy, mxz, myz FROM moments"),
    "bins_dropped": _with(E[:4], "SELECT seg, level, sum(CASE WHEN NOT fixed AND m >= 6 THEN 1 ELSE 0 END)::BIGINT AS estimated, sum(CASE WHEN NOT fixed AND m < 6 THEN 1 ELSE 0 END)::BIGINT AS dropped FROM moments GROUP BY ALL"),
    "plane_normals": _with(E, "SELECT seg, level, kx, ky, kz, round(nx / 1000.0::DOUBLE)::BIGINT AS nx, round(ny / 1000.0::DOUBLE)::BIGINT AS ny, round(nz / 1000.0::DOUBLE)::BIGINT AS nz FROM oriented WHERE NOT fixed"),
    "voxel_range": _with(E, f"SELECT layer, count(*)::BIGINT AS rows, min(gx) AS gx0, max(gx) AS gx1, min(gy) AS gy0, max(gy) AS gy1, min(gz) AS gz0, max(gz) AS gz1 FROM ({_splat('oriented')}) GROUP BY ALL"),
    "voxel_field": _with(FIELD, "SELECT * FROM field"),
    "layer_sum": _with(FIELD, _summed("field")),
    "retract_layer": _with(FIELD, _summed("(SELECT * FROM field WHERE layer <> 1)")),
    "preview_replaced_field": _with([*E, ("live", "SELECT * FROM oriented WHERE level = 1 OR seg NOT IN (SELECT seg FROM oriented WHERE level = 1)"), ("field", _field(_splat("live")))], _summed("field")),
    "block_lists": _with(E, _lists()),
    "height_cells": _with(BN, HC),
    "height_quads": _with(HQ, "SELECT cx, cy, round(z00 * 1000)::BIGINT AS z00, round(z10 * 1000)::BIGINT AS z10, round(z11 * 1000)::BIGINT AS z11, round(z01 * 1000)::BIGINT AS z01 FROM hq"),
    "height_triangles": _with(HQ, f"SELECT bx, by, (row_number() OVER (PARTITION BY bx, by ORDER BY cy, cx, half) - 1)::INT AS ord, x0, y0, z0, x1, y1, z1, x2, y2, z2 FROM ({_tri((_a, _b, _c), 0)} UNION ALL {_tri((_a, _c, _d), 1)})"),
    "cell_vertices": _with(VERTS, "SELECT * FROM verts"),
    "sign_edges": _with(VERTS, "SELECT * FROM edges"),
    "quads": _with(QUADS, f"SELECT {QUAD_COLUMNS} FROM quads"),
    "block_vertices": _with(USED, "SELECT * FROM used"),
    "seam_vertices": _with(USED, "SELECT bx, by, bz, cx, cy, cz, x, y, z FROM used WHERE least(cx - bx * 8, cy - by * 8, cz - bz * 8) = -1 OR greatest(cx - bx * 8, cy - by * 8, cz - bz * 8) = 7"),
    "block_mesh_stats": _with(USED, MESH_STATS),
    "mesh_statistics": _with([*USED, ("s", MESH_STATS)], "SELECT count(*)::BIGINT AS blocks, sum(vertices)::BIGINT AS vertices, sum(triangles)::BIGINT AS triangles, sum(vertices * 15 + triangles * 12)::BIGINT AS bytes FROM s"),
    "block_digests": _with(USED, _digests("quads", "used")),
    "dirty_blocks": _with(DIRTY1, "SELECT * FROM dirty"),
    "halo_mask": _with(FIELD, _halo("field", upper=True)),
    "changed_blocks": _with(STATES, "SELECT coalesce(a.bx, b.bx) AS bx, coalesce(a.by, b.by) AS by, coalesce(a.bz, b.bz) AS bz, (CASE WHEN a.digest IS NULL THEN 1 ELSE 2 END)::BIGINT AS version, b.digest IS NULL AS gone FROM dig_a a FULL JOIN dig_b b ON a.bx = b.bx AND a.by = b.by AND a.bz = b.bz WHERE a.digest IS DISTINCT FROM b.digest"),
    "extract_stats": _with([*STATES, *DIRTY1[len(E):], ("j", "SELECT d.direct, a.digest AS o, b.digest AS n FROM dirty d LEFT JOIN dig_a a ON a.bx = d.bx AND a.by = d.by AND a.bz = d.bz LEFT JOIN dig_b b ON b.bx = d.bx AND b.by = d.by AND b.bz = d.bz")],
                           "SELECT count(*)::BIGINT AS reextracted, sum(direct::INT)::BIGINT AS direct, sum((o IS DISTINCT FROM n)::INT)::BIGINT AS updated, sum((o IS NOT DISTINCT FROM n AND direct AND n IS NOT NULL)::INT)::BIGINT AS unchanged_direct, sum((o IS NOT DISTINCT FROM n AND NOT direct AND n IS NOT NULL)::INT)::BIGINT AS unchanged_neighbor, sum((o IS NULL AND n IS NULL)::INT)::BIGINT AS unchanged_empty FROM j"),
    "segment_admission": _with([*P, ("arrivals", "SELECT DISTINCT seg, level FROM points"), ("refined", "SELECT seg FROM arrivals WHERE level = 1 AND seg < 2")], "SELECT seg, level, CASE WHEN seg NOT IN (SELECT seg FROM refined) THEN 'accepted' WHEN level = 1 THEN 'AlreadyRefined' ELSE 'PreviewAfterRefined' END AS reason FROM arrivals"),
    "neighbor_edges": _with(GRAPH, "SELECT * REPLACE (round(v * 1000)::BIGINT AS v) FROM graph"),
    "components": _with(LOOSE, "SELECT seg, level, kx, ky, kz, label.kx AS cx, label.ky AS cy, label.kz AS cz FROM labels", recursive=True),
    "best_seed_edge": _with(GRAPH, "SELECT seg, level, skx, sky, skz, tkx, tky, tkz, round(v * 1000000)::BIGINT AS v FROM graph WHERE NOT dst_need QUALIFY row_number() OVER (PARTITION BY seg, level, skx, sky, skz ORDER BY least(abs(v), 1.0::DOUBLE) DESC, tkx, tky, tkz) = 1"),
    "base_agreement": _with(AGREE, "SELECT seg, level, kx, ky, kz, round(a * 1000)::BIGINT AS a FROM agree"),
    "oracle_signs": _with(AGREE, "SELECT seg, count(*)::BIGINT AS bins, sum((fixed OR coalesce(abs(a) >= 0.3, false))::INT)::BIGINT AS fixed, sum((CASE WHEN NOT fixed AND coalesce(a <= -0.3, false) THEN -nz ELSE nz END < 0)::INT)::BIGINT AS down FROM (SELECT o.*, agree.a FROM oriented o LEFT JOIN agree ON agree.seg = o.seg AND agree.level = o.level AND agree.kx = o.kx AND agree.ky = o.ky AND agree.kz = o.kz WHERE o.level = 0) GROUP BY ALL"),
    "weld_counts": _with([*USED, ("w", "SELECT x, y, z, count(*) AS uses, arg_min(r, (bx, by, bz, idx)) AS r FROM used GROUP BY x, y, z")], "SELECT count(*)::BIGINT AS welded, sum(uses)::BIGINT AS vertices, sum(r)::BIGINT AS r FROM w"),
    "weld_vertices": _with(USED, "SELECT x, y, z, arg_min(r, (bx, by, bz, idx))::INT AS r, arg_min(g, (bx, by, bz, idx))::INT AS g, arg_min(b, (bx, by, bz, idx))::INT AS b, count(*)::BIGINT AS uses FROM used GROUP BY x, y, z"),
    "far_fraction": _with([*USED, ("mm", MM), ("pts", "SELECT DISTINCT x, y, z, floor(x / 100.0)::BIGINT AS kx, floor(y / 100.0)::BIGINT AS ky FROM points"),
                           ("hit", "SELECT DISTINCT v.x, v.y, v.z FROM (SELECT *, unnest([-1, 0, 1]) AS dx FROM (SELECT *, unnest([-1, 0, 1]) AS dy FROM mm)) v JOIN pts p ON p.kx = floor(v.x / 100.0)::BIGINT + v.dx AND p.ky = floor(v.y / 100.0)::BIGINT + v.dy AND (p.x - v.x) * (p.x - v.x) + (p.y - v.y) * (p.y - v.y) + (p.z - v.z) * (p.z - v.z) <= 10000")],
                          "SELECT n AS vertices, n - h AS far, round((n - h) / n, 6) AS fraction FROM (SELECT (SELECT count(*) FROM mm)::BIGINT AS n, (SELECT count(*) FROM hit)::BIGINT AS h)"),
    "stream_replay_final_field": _with([*E, ("live", "SELECT * FROM oriented WHERE level = 1"), ("field", _field(_splat("live")))], _summed("field")),
    "stream_replay_meshes": _with([*E, *_branch("c", "level = 1")], "SELECT * FROM dig_c"),
    "height_meshes": _with([*HF, ("hused", _used("hfaces")), ("dig", _digests("hfaces", "hused")), ("hn", MESH_STATS.replace("used", "hused").replace("quads", "hfaces"))],
                           "SELECT hn.bx, hn.by, 0::BIGINT AS bz, vertices, triangles, digest FROM hn JOIN dig ON dig.bx = hn.bx AND dig.by = hn.by"),
}
