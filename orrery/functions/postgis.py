"""The geospatial namespace: functions over geometries as Arrow-batched Python functions, boxes as Spark expressions.

A geometry column holds extended well-known text; a box is a struct of its six bounds. Null arguments give null.
Functions that need general topology, projections or curves raise an error that names them.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import replace
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lexer import QueryError
from . import geometry as g
from .geometry import Geometry, GeometryError

BOX = "struct<xmin:double,ymin:double,zmin:double,xmax:double,ymax:double,zmax:double>"
#: What geometry columns are.
TYPES = {"geometry": "string", "geography": "string", "box2d": BOX, "box3d": BOX}


@lru_cache(maxsize=4096)
def _read(text: str) -> Geometry:
    return g.from_text(text)


def _shown(x):
    if isinstance(x, Geometry):
        return g.to_text(x, extended=True)
    return [_shown(v) for v in x] if isinstance(x, list) else x


def _point(x, kind: str = "POINT") -> Geometry:
    return Geometry("POINT", tuple(map(float, x)))


def _only(kind: str, default=None):
    """A function of geometries of one kind, null for others."""
    return lambda f: lambda a, *rest: f(a, *rest) if a.kind == kind and not a.empty else default


_line, _of_point, _of_polygon = _only("LINESTRING"), _only("POINT"), _only("POLYGON")


def _nth(items: list, n: int):
    return items[n - 1] if 1 <= n <= len(items) else None


def _run(a: Geometry, run: list) -> Geometry:
    return a.like("LINESTRING", run) if len(run) > 1 else a.like("POINT", run[0]) if run else a.like("LINESTRING", [])


def _ordinate(k: int):
    @_of_point
    def read(a):
        if k == 3:
            return a.data[2 + a.z] if a.m else None
        return a.data[k] if k < 2 or a.z else None

    return read


def _forced(z: bool, m: bool, fill_z: float = 0.0, fill_m: float = 0.0):
    def force(a, first=None, second=None):
        zs, ms = (first if z and first is not None else fill_z), ((second if z else first) if m and (second if z else first) is not None else fill_m)
        to = lambda c: (*c[:2], *([c[2] if a.z else zs] if z else []), *([c[2 + a.z] if a.m else ms] if m else []))
        out = a.mapped(to)
        mark = lambda x: replace(x, z=z, m=m, data=[mark(p) for p in x.data] if x.kind == "GEOMETRYCOLLECTION" else x.data)
        return mark(out)

    return force


def _rings(a: Geometry, ccw: bool) -> Geometry:
    def turned(rings):
        return [r if (g.ring_area(r) > 0) == (ccw if k == 0 else not ccw) else r[::-1] for k, r in enumerate(rings)]

    if a.kind == "POLYGON":
        return a.like("POLYGON", turned(a.data))
    if a.kind == "MULTIPOLYGON":
        return a.like(a.kind, [turned(p) for p in a.data])
    return a


def _collected(items: list[Geometry]) -> Geometry | None:
    items = [x for x in items if x is not None]
    if not items:
        return None
    first = items[0]
    same = {x.kind for x in items}
    if len(same) == 1 and "MULTI" + first.kind in g.PART:
        return first.like("MULTI" + first.kind, [x.data for x in items])
    return first.like("GEOMETRYCOLLECTION", [replace(x, srid=0) for x in items])


def _extracted(a: Geometry, number: int | None = None) -> Geometry:
    kinds = {1: "POINT", 2: "LINESTRING", 3: "POLYGON"}
    number = number or max((g.NUMBERS[s.kind] for s in a.simple()), default=1)
    return a.like("MULTI" + kinds[number], [s.data for s in a.simple() if s.kind == kinds[number]])


def _homogenized(a: Geometry) -> Geometry:
    parts = a.simple()
    return replace(parts[0], srid=a.srid) if len(parts) == 1 else replace(_collected(parts) or a, srid=a.srid)


def _made_line(items: list[Geometry]) -> Geometry:
    cs = [c for x in items for c in x.coords()]
    return items[0].like("LINESTRING", [c for k, c in enumerate(cs) if k == 0 or c != cs[k - 1]] if len(cs) > 2 else cs)


def _closed(a: Geometry) -> bool:
    return all(s.data[0] == s.data[-1] if s.kind == "LINESTRING" else True for s in a.simple())


def _simple_line(run: list) -> bool:
    for i, (a, b) in enumerate(zip(run, run[1:], strict=False)):
        for j in range(i + 1, len(run) - 1):
            x = g.crossing(a, b, run[j], run[j + 1])
            if x is None or j == i + 1 and x == b[:2] and g.crossing(a, a, run[j], run[j + 1]) is None:
                continue
            if not (i == 0 and j == len(run) - 2 and x == run[0][:2] == run[-1][:2]):
                return False
    return True


def _is_simple(a: Geometry) -> bool:
    points = [s.data[:2] for s in a.simple() if s.kind == "POINT"]
    return len(set(points)) == len(points) and all(_simple_line(s.data) for s in a.simple() if s.kind == "LINESTRING")


def _reason(a: Geometry) -> str:
    for s in a.simple():
        if s.kind == "LINESTRING" and len({c[:2] for c in s.data}) < 2:
            return "Too few points in geometry component"
        for ring in s.data if s.kind == "POLYGON" else []:
            if ring[0][:2] != ring[-1][:2] or len(ring) < 4:
                return "Too few points in geometry component"
            if not _simple_line(ring):
                return "Self-intersection"
        if s.kind == "POLYGON" and any(g.in_ring(c, s.data[0]) < 0 for hole in s.data[1:] for c in hole):
            return "Hole lies outside shell"
    return "Valid Geometry"


def _boundary(a: Geometry) -> Geometry:
    if a.kind in ("POINT", "MULTIPOINT"):
        return a.like("GEOMETRYCOLLECTION", [])
    if a.kind in ("POLYGON", "MULTIPOLYGON"):
        rings = [r for s in a.simple() for r in s.data]
        return a.like("LINESTRING", rings[0]) if len(rings) == 1 else a.like("MULTILINESTRING", rings)
    ends: dict[tuple, int] = {}
    for s in a.simple():
        for e in (s.data[0], s.data[-1]):
            ends[e] = ends.get(e, 0) + 1
    return a.like("MULTIPOINT", [e for e, n in ends.items() if n % 2])


def _affine(a: Geometry, *v: float) -> Geometry:
    if len(v) == 6:
        xx, xy, yx, yy, dx, dy = v
        return a.mapped(lambda c: (xx * c[0] + xy * c[1] + dx, yx * c[0] + yy * c[1] + dy, *c[2:]))
    xx, xy, xz, yx, yy, yz, zx, zy, zz, dx, dy, dz = v

    def move(c):
        z = c[2] if a.z else 0.0
        out = (xx * c[0] + xy * c[1] + xz * z + dx, yx * c[0] + yy * c[1] + yz * z + dy, zx * c[0] + zy * c[1] + zz * z + dz)
        return (*out[: 2 + a.z], *c[2 + a.z :])

    return a.mapped(move)


def _rotated(a: Geometry, angle: float, *about) -> Geometry:
    x0, y0 = (about[0].data[:2] if isinstance(about[0], Geometry) else about[:2]) if about else (0.0, 0.0)
    s, c = math.sin(angle), math.cos(angle)
    return _affine(a, c, -s, s, c, x0 - c * x0 + s * y0, y0 - s * x0 - c * y0)


def _scaled(a: Geometry, *v) -> Geometry:
    if isinstance(v[0], Geometry):
        f = v[0].data
        o = v[1].data if len(v) > 1 else (0.0,) * 4
        return a.mapped(lambda c: tuple(o[k] + (x - o[k]) * f[k] if k < len(f) and k < len(o) else x for k, x in enumerate(c)))
    return a.mapped(lambda c: tuple(x * v[k] if k < len(v) else x for k, x in enumerate(c)))


def _snapped(a: Geometry, *v: float) -> Geometry:
    ox, oy, sx, sy = (0.0, 0.0, v[0], v[0]) if len(v) == 1 else (0.0, 0.0, *v) if len(v) == 2 else v[:4]
    snap = lambda x, o, s: round((x - o) / s) * s + o if s else x

    def run(cs):
        moved = [(snap(c[0], ox, sx), snap(c[1], oy, sy), *c[2:]) for c in cs]
        return [c for k, c in enumerate(moved) if k == 0 or c != moved[k - 1]]

    return a.each_run(run)


def _azimuth_between(*ps: Geometry) -> float | None:
    if len(ps) == 2 and ps[0].kind == "LINESTRING":
        (a, b), (c, d) = (x.data[:: len(x.data) - 1] for x in ps)
    elif len(ps) == 3:
        b, a, d = ps[1].data, ps[0].data, ps[2].data
        first, second = g.azimuth(b, a), g.azimuth(b, d)
        return None if first is None or second is None else (second - first) % (2 * math.pi)
    else:
        a, b = ps[0].data, ps[1].data
        c, d = (ps[2].data, ps[3].data) if len(ps) == 4 else (a, b)
    first, second = g.azimuth(a, b), g.azimuth(c, d)
    return None if first is None or second is None else (second - first) % (2 * math.pi)


def _along(a: Geometry, lo: float, hi: float, k: int) -> Geometry:
    """The parts of lines whose ordinate k lies from lo to hi."""
    parts, points = [], []
    for s in a.simple():
        if s.kind == "POINT":
            points += [s.data] if lo <= s.data[k] <= hi else []
            continue
        run: list = []
        for p, q in zip(s.data, s.data[1:], strict=False):
            d = q[k] - p[k]
            ts = sorted(((lo - p[k]) / d, (hi - p[k]) / d)) if d else ([0.0, 1.0] if lo <= p[k] <= hi else [2.0, 2.0])
            t0, t1 = max(0.0, ts[0]), min(1.0, ts[1])
            if t0 > t1:
                continue
            ends = [tuple(x + t * (y - x) for x, y in zip(p, q, strict=True)) for t in ([t0, t1] if t1 > t0 else [t0])]
            if run and run[-1] == ends[0]:
                run += ends[1:]
            else:
                if run:
                    (parts if len(run) > 1 else points).append(run if len(run) > 1 else run[0])
                run = ends
        if run:
            (parts if len(run) > 1 else points).append(run if len(run) > 1 else run[0])
    points = [p for i, p in enumerate(points) if p not in points[:i]]
    if parts and not points:
        return a.like("MULTILINESTRING", parts) if len(parts) > 1 or lo == hi else a.like("LINESTRING", parts[0])
    if points and not parts:
        return a.like("MULTIPOINT", points)
    return a.like("GEOMETRYCOLLECTION", [a.like("LINESTRING", p) for p in parts] + [a.like("POINT", p) for p in points])


def _measured(a: Geometry, lo: float, hi: float) -> Geometry:
    def run(cs):
        done, total, out = 0.0, g.length(cs), []
        for k, c in enumerate(cs):
            done += g.distance(cs[k - 1], c) if k else 0.0
            out.append((*c[: 2 + a.z], lo + (hi - lo) * (done / total if total else 0.0)))
        return out

    return replace(a.each_run(run), m=True)


def _relates(pattern: str, matrix: str) -> bool:
    fits = {"T": "012T", "F": "F", "*": "012TF", "0": "0", "1": "1", "2": "2"}
    return len(pattern) == len(matrix) == 9 and all(x.upper() in fits.get(p.upper(), "") for x, p in zip(pattern, matrix, strict=True))


def _two_points(found) -> Geometry | None:
    return None if found is None else Geometry("LINESTRING", [tuple(map(float, found[1])), tuple(map(float, found[2]))])


def _point_of(found) -> Geometry | None:
    return None if found is None else _point(found[1])


def _least(n: int = 2):
    return lambda a, b: None if (f := g.shortest(a, b, n)) is None else f[0]


def _typed(kind: str, binary: bool = False):
    def read(x, srid: int = 0):
        a = g.from_binary(x) if binary else g.from_text(x)
        return replace(a, srid=srid or a.srid) if a.kind == kind else None

    return read


def _from_text(x: str, srid: int = 0) -> Geometry:
    a = g.from_text(x)
    return replace(a, srid=srid or a.srid)


def _json(a: Geometry, digits: int = 9, options: int = 8) -> str:
    return json.dumps(g.to_json(a, digits), separators=(",", ":"))


def _xml(a: Geometry, tag: str, sep: str, between: str, style: str, digits: int = 15) -> str:
    """GML and KML."""
    show = lambda cs: between.join(sep.join(g.number(round(v, digits)) for v in c[: 2 + a.z]) for c in cs)
    t = lambda name, inner: f"<{tag}{name}>{inner}</{tag}{name}>"
    many = f' srsName="EPSG:{a.srid}"' if style == "gml" and a.srid else ""
    wrap = lambda name, inner: f"<{tag}{name}{many}>{inner}</{tag}{name}>"
    coords = (lambda cs: t("coordinates", show(cs)))
    if a.kind == "POINT":
        return wrap("Point", coords([a.data]))
    if a.kind == "LINESTRING":
        return wrap("LineString", coords(a.data))
    if a.kind == "POLYGON":
        return wrap("Polygon", "".join(t("outerBoundaryIs" if k == 0 else "innerBoundaryIs", t("LinearRing", coords(r))) for k, r in enumerate(a.data)))
    if style == "kml":
        return wrap("MultiGeometry", "".join(_xml(p, tag, sep, between, style, digits) for p in a.parts()))
    member = {"MULTIPOINT": "point", "MULTILINESTRING": "lineString", "MULTIPOLYGON": "polygon"}.get(a.kind, "geometry")
    return wrap(g.TITLES[a.kind] if a.kind != "GEOMETRYCOLLECTION" else "MultiGeometry", "".join(t(member + "Member", _xml(replace(p, srid=0), tag, sep, between, style, digits)) for p in a.parts()))


def _svg(a: Geometry, relative: int = 0, digits: int = 15) -> str:
    show = lambda v: g.number(round(v, digits))
    if a.kind == "POINT":
        x, y = show(a.data[0]), show(-a.data[1])
        return f'x="{x}" y="{y}"' if relative else f'cx="{x}" cy="{y}"'

    def path(run, close):
        first = f"M {show(run[0][0])} {show(-run[0][1])}"
        if relative:
            rest = " ".join(f"{show(b[0] - c[0])} {show(c[1] - b[1])}" for c, b in zip(run, run[1:], strict=False))
            return f"{first} l {rest}" + (" z" if close else "")
        run = run[:-1] if close else run
        return f"{first} L " + " ".join(f"{show(c[0])} {show(-c[1])}" for c in run[1:]) + (" Z" if close else "")

    if a.kind == "LINESTRING":
        return path(a.data, False)
    if a.kind == "POLYGON":
        return " ".join(path(r, True) for r in a.data)
    return (";" if a.kind == "GEOMETRYCOLLECTION" else "," if a.kind == "MULTIPOINT" else " ").join(_svg(p, relative, digits) for p in a.parts())


def _geohash(a: Geometry, size: int = 20) -> str:
    x0, y0, _, x1, y1, _ = g.box(a)
    return g.geohash((x0 + x1) / 2, (y0 + y1) / 2, size)


def _rectangle(x0, y0, x1, y1, srid: int = 0) -> Geometry:
    return Geometry("POLYGON", [[(x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)]], int(srid))


def _envelope(a: Geometry) -> Geometry:
    b = g.box(a)
    if b is None:
        return a
    x0, y0, _, x1, y1, _ = b
    if (x0, y0) == (x1, y1):
        return Geometry("POINT", (x0, y0), a.srid)
    return Geometry("LINESTRING", [(x0, y0), (x1, y1)], a.srid) if x0 == x1 or y0 == y1 else _rectangle(x0, y0, x1, y1, a.srid)


def _degrees(a: Geometry, form: str = "") -> str:
    def one(v, names):
        sign, v = names[v < 0], abs(v)
        d = int(v)
        m = int((v - d) * 60)
        return f"{d}°{m}'{(v - d - m / 60) * 3600:.3f}\"{sign}"

    return f"{one(a.data[1], 'NS')} {one(a.data[0], 'EW')}"


def _replaced(run: list, at: int, c: tuple | None, insert: bool = False) -> list:
    at = at + len(run) if at < 0 and not insert else at
    if insert:
        return [*run, c] if at < 0 else [*run[:at], c, *run[at:]]
    if not 0 <= at < len(run):
        raise GeometryError("point index is out of range")
    return [*run[:at], *([] if c is None else [c]), *run[at + 1 :]]


def _projected(a: Geometry, far: float, azimuth) -> Geometry:
    if isinstance(azimuth, Geometry):
        raise GeometryError("project takes an azimuth")
    x, y = a.data[:2]
    return Geometry("POINT", (x + far * math.sin(azimuth), y + far * math.cos(azimuth)), a.srid)


def _extended(a: Geometry, ahead: float, back: float = 0.0) -> Geometry:
    def out(p, q, d):
        n = g.distance(p, q)
        return (q[0] + (q[0] - p[0]) * d / n, q[1] + (q[1] - p[1]) * d / n)

    run = [c[:2] for c in a.data]
    return a.like("LINESTRING", [*([out(run[1], run[0], back)] if back else []), *run, *([out(run[-2], run[-1], ahead)] if ahead else [])])


def _points_at(a: Geometry, step: float, repeat: bool = True) -> Geometry:
    if not repeat:
        return a.like("POINT", g.at_fraction(a.data, step))
    n = int(1 / step + 1e-9)
    pts = [g.at_fraction(a.data, min(1.0, k * step)) for k in range(1, n + 1)]
    return a.like("MULTIPOINT", pts) if len(pts) > 1 else a.like("POINT", pts[0])


def _without_repeats(a: Geometry, tolerance: float = 0.0) -> Geometry:
    def run(cs):
        out = cs[:1]
        for c in cs[1:]:
            if g.distance(c, out[-1]) > tolerance:
                out.append(c)
        return out if len(out) > 1 or len(cs) == 1 else [cs[0], cs[-1]]

    if a.kind == "MULTIPOINT":
        return a.like(a.kind, list(dict.fromkeys(a.data)))
    return a.each_run(run)


def _scrolled(a: Geometry, p: Geometry) -> Geometry:
    if a.data[0] != a.data[-1] or p.data not in a.data:
        raise GeometryError("scroll needs a closed line and one of its points")
    k = a.data.index(p.data)
    return a.like("LINESTRING", [*a.data[k:], *a.data[1:k], p.data]) if k else a


def _wrapped(a: Geometry, wrap: float, move: float) -> Geometry:
    return a.mapped(lambda c: (c[0] + move if (c[0] < wrap if move > 0 else c[0] > wrap) else c[0], *c[1:]))


def _crossing_direction(a: Geometry, b: Geometry) -> int:
    turns = []
    for p, q in zip(a.data, a.data[1:], strict=False):
        for r, u in zip(b.data, b.data[1:], strict=False):
            if g.side(p, r, u) * g.side(q, r, u) < 0 and g.crossing(p, q, r, u):
                turns.append(-1 if g.side(p, r, u) > 0 else 1)
    total = sum(turns)
    if not turns:
        return 0
    return total if abs(total) == 1 and len(turns) == 1 else (2 if total > 0 else -2) if total and abs(total) > 1 else (3 if turns[0] > 0 else -3)


def _touches(a: Geometry, b: Geometry) -> bool:
    return g.intersects(a, b) and not g.interiors_meet(a, b)


def _overlaps(a: Geometry, b: Geometry) -> bool:
    same = g.dimension(a) == g.dimension(b)
    return same and g.interiors_meet(a, b) and not g.covers(a, b) and not g.covers(b, a)


def _crosses(a: Geometry, b: Geometry) -> bool:
    da, db = g.dimension(a), g.dimension(b)
    if da == db == 1:
        return g.interiors_meet(a, b) and not any(_shared_run(s, t) for s in a.simple() for t in b.simple())
    small, large = (a, b) if da < db else (b, a)
    return da != db and g.interiors_meet(small, large) and not g.covers(large, small)


def _shared_run(s: Geometry, t: Geometry) -> bool:
    pts = [p for p in g.samples(s, t) if g.place(p, t) >= 0]
    return len(pts) > 2


# name: (kinds of the arguments, result, function). Kinds: g geometry, n number, i integer, s text, b bytes, t truth,
# a array of geometries; those after '/' may be left out.
FUNCTIONS: dict[str, tuple[str, str, Callable]] = {
    # ordinates and structure
    "x": ("g", "double", _ordinate(0)), "y": ("g", "double", _ordinate(1)), "z": ("g", "double", _ordinate(2)), "m": ("g", "double", _ordinate(3)),
    "coorddim": ("g", "smallint", lambda a: 2 + a.z + a.m), "ndims": ("g", "smallint", lambda a: 2 + a.z + a.m), "zmflag": ("g", "smallint", lambda a: 2 * a.z + a.m),
    "hasz": ("g", "boolean", lambda a: a.z), "hasm": ("g", "boolean", lambda a: a.m), "hasarc": ("g", "boolean", lambda a: False), "dimension": ("g", "bigint", g.dimension),
    "geometrytype": ("g", "string", lambda a: "ST_" + g.TITLES[a.kind]), "isempty": ("g", "boolean", lambda a: a.empty), "iscollection": ("g", "boolean", lambda a: a.kind in g.PART or a.kind == "GEOMETRYCOLLECTION"),
    "npoints": ("g", "bigint", lambda a: len(a.coords())), "numpoints": ("g", "bigint", _line(lambda a: len(a.data))), "nrings": ("g", "bigint", lambda a: sum(len(s.data) for s in a.simple() if s.kind == "POLYGON")),
    "numgeometries": ("g", "bigint", lambda a: 0 if a.empty else len(a.parts())), "numinteriorring": ("g", "bigint", _of_polygon(lambda a: len(a.data) - 1)), "numinteriorrings": ("g", "bigint", _of_polygon(lambda a: len(a.data) - 1)),
    "numpatches": ("g", "bigint", lambda a: None), "numcurves": ("g", "bigint", _line(lambda a: 1)), "curven": ("gi", "g", lambda a, n: a if a.kind == "LINESTRING" and n == 1 else None), "patchn": ("gi", "g", lambda a, n: None),
    "geometryn": ("gi", "g", lambda a, n: _nth(a.parts(), n)), "pointn": ("gi", "g", _line(lambda a, n: (p := _nth(a.data, n) if n > 0 else a.data[n] if -len(a.data) <= n < 0 else None) and a.like("POINT", p))),
    "startpoint": ("g", "g", _line(lambda a: a.like("POINT", a.data[0]))), "endpoint": ("g", "g", _line(lambda a: a.like("POINT", a.data[-1]))),
    "exteriorring": ("g", "g", _of_polygon(lambda a: a.like("LINESTRING", a.data[0]))), "interiorringn": ("gi", "g", _of_polygon(lambda a, n: (r := _nth(a.data[1:], n)) and a.like("LINESTRING", r))),
    "points": ("g", "g", lambda a: a.like("MULTIPOINT", a.coords())), "boundary": ("g", "g", _boundary), "srid": ("g", "bigint", lambda a: a.srid), "setsrid": ("gi", "g", lambda a, n: replace(a, srid=n)),
    "summary": ("g", "string", lambda a: f"{g.TITLES[a.kind]}[{'Z' * a.z}{'M' * a.m}{'S' * bool(a.srid)}] with {len(a.coords())} points"),
    # measures
    "area": ("g", "double", g.area), "area2d": ("g", "double", g.area), "centroid": ("g", "g", g.centroid), "convexhull": ("g", "g", g.hull),
    "length": ("g", "double", lambda a: g.total_length(a, "LINESTRING")), "length2d": ("g", "double", lambda a: g.total_length(a, "LINESTRING")), "length3d": ("g", "double", lambda a: g.total_length(a, "LINESTRING", 2 + a.z)),
    "perimeter": ("g", "double", lambda a: g.total_length(a, "POLYGON")), "perimeter2d": ("g", "double", lambda a: g.total_length(a, "POLYGON")), "perimeter3d": ("g", "double", lambda a: g.total_length(a, "POLYGON", 2 + a.z)),
    "azimuth": ("gg", "double", lambda a, b: g.azimuth(a.data, b.data)), "angle": ("gg/gg", "double", _azimuth_between), "distancesphere": ("gg/n", "double", lambda a, b, r=g.SPHERE: g.great_circle(a.data, b.data, r)),
    "distancespheroid": ("gg", "double", lambda a, b: g.geodesic(a.data, b.data)), "distance": ("gg", "double", _least()), "distance3d": ("gg", "double", _least(3)),
    "maxdistance": ("gg", "double", lambda a, b: (f := g.longest(a, b)) and f[0]), "maxdistance3d": ("gg", "double", lambda a, b: (f := g.longest(a, b, 3)) and f[0]),
    "dwithin": ("ggn", "boolean", lambda a, b, d: (x := _least()(a, b)) is not None and x <= d), "dwithin3d": ("ggn", "boolean", lambda a, b, d: (x := _least(3)(a, b)) is not None and x <= d),
    "dfullywithin": ("ggn", "boolean", lambda a, b, d: (f := g.longest(a, b)) is not None and f[0] <= d), "dfullywithin3d": ("ggn", "boolean", lambda a, b, d: (f := g.longest(a, b, 3)) is not None and f[0] <= d),
    "closestpoint": ("gg", "g", lambda a, b: _point_of(g.shortest(a, b))), "closestpoint3d": ("gg", "g", lambda a, b: _point_of(g.shortest(a, b, 3))),
    "shortestline": ("gg", "g", lambda a, b: _two_points(g.shortest(a, b))), "shortestline3d": ("gg", "g", lambda a, b: _two_points(g.shortest(a, b, 3))),
    "longestline": ("gg", "g", lambda a, b: _two_points(g.longest(a, b))), "longestline3d": ("gg", "g", lambda a, b: _two_points(g.longest(a, b, 3))),
    "frechetdistance": ("gg/n", "double", lambda a, b, _=-1.0: g.frechet(a.coords(), b.coords())), "hausdorffdistance": ("gg/n", "double", lambda a, b, _=-1.0: g.hausdorff(a, b)),
    "geometricmedian": ("g", "g", lambda a: a.like("POINT", g.median(a.coords()))), "pointinsidecircle": ("gnnn", "boolean", lambda a, x, y, r: g.distance(a.data, (x, y)) <= r),
    # predicates
    "intersects": ("gg", "boolean", g.intersects), "intersects3d": ("gg", "boolean", lambda a, b: _least(3)(a, b) == 0), "disjoint": ("gg", "boolean", lambda a, b: not g.intersects(a, b)), "covers": ("gg", "boolean", g.covers),
    "coveredby": ("gg", "boolean", lambda a, b: g.covers(b, a)), "contains": ("gg", "boolean", lambda a, b: g.covers(a, b) and g.interiors_meet(a, b)), "within": ("gg", "boolean", lambda a, b: g.covers(b, a) and g.interiors_meet(a, b)),
    "containsproperly": ("gg", "boolean", lambda a, b: not b.empty and all(g.place(p, a) == 1 for p in g.samples(b, a))), "equals": ("gg", "boolean", lambda a, b: a.empty and b.empty or g.covers(a, b) and g.covers(b, a)),
    "orderingequals": ("gg", "boolean", lambda a, b: a.kind == b.kind and a.coords() == b.coords()), "touches": ("gg", "boolean", _touches), "overlaps": ("gg", "boolean", _overlaps), "crosses": ("gg", "boolean", _crosses),
    "issimple": ("g", "boolean", _is_simple), "isvalid": ("g/i", "boolean", lambda a, _=0: _reason(a) == "Valid Geometry"), "isvalidreason": ("g/i", "string", lambda a, _=0: _reason(a)), "isclosed": ("g", "boolean", _closed),
    "isring": ("g", "boolean", _line(lambda a: _closed(a) and _simple_line(a.data))), "ispolygonccw": ("g", "boolean", lambda a: _rings(a, True) == a), "ispolygoncw": ("g", "boolean", lambda a: _rings(a, False) == a),
    "linecrossingdirection": ("gg", "bigint", _crossing_direction), "relatematch": ("ss", "boolean", _relates),
    # makers
    "point": ("nn/i", "g", lambda x, y, s=0: replace(_point((x, y)), srid=s)), "makepoint": ("nn/nn", "g", lambda *c: replace(_point(c), z=len(c) > 2, m=len(c) > 3)), "makepointm": ("nnn", "g", lambda *c: replace(_point(c), m=True)),
    "pointz": ("nnn/i", "g", lambda x, y, z, s=0: replace(_point((x, y, z)), z=True, srid=s)), "pointm": ("nnn/i", "g", lambda x, y, m, s=0: replace(_point((x, y, m)), m=True, srid=s)),
    "pointzm": ("nnnn/i", "g", lambda x, y, z, m, s=0: replace(_point((x, y, z, m)), z=True, m=True, srid=s)), "makeline": ("*", "g", lambda a, b=None: _made_line(a if isinstance(a, list) else [a, b])),
    "makepolygon": ("g/a", "g", lambda a, holes=(): a.like("POLYGON", [a.data, *[h.data for h in holes]])), "polygon": ("gi", "g", lambda a, s: replace(a.like("POLYGON", [a.data]), srid=s)),
    "collect": ("*", "g", lambda a, b=None: _collected(a if isinstance(a, list) else [a, b])), "multi": ("g", "g", lambda a: a.like("MULTI" + a.kind, [a.data]) if "MULTI" + a.kind in g.PART else a), "linefrommultipoint": ("g", "g", lambda a: a.like("LINESTRING", list(a.data))),
    "collectionextract": ("g/i", "g", _extracted), "collectionhomogenize": ("g", "g", _homogenized), "forcecollection": ("g", "g", lambda a: a if a.kind == "GEOMETRYCOLLECTION" else a.like("GEOMETRYCOLLECTION", [replace(p, srid=0) for p in a.parts()])),
    "makeenvelope": ("nnnn/i", "g", _rectangle), "envelope": ("g", "g", _envelope), "boundingdiagonal": ("g/t", "g", lambda a, _=False: a.like("LINESTRING", [(b := g.box(a))[:2], b[3:5]])), "project": ("gnn", "g", _projected),
    # changes
    "force2d": ("g", "g", _forced(False, False)), "force3d": ("g/n", "g", _forced(True, False)), "force3dz": ("g/n", "g", _forced(True, False)), "force3dm": ("g/n", "g", _forced(False, True)), "force4d": ("g/nn", "g", _forced(True, True)),
    "forcesfs": ("g/s", "g", lambda a, _="": a), "forcepolygonccw": ("g", "g", lambda a: _rings(a, True)), "forcepolygoncw": ("g", "g", lambda a: _rings(a, False)), "forcerhr": ("g", "g", lambda a: _rings(a, False)),
    "flipcoordinates": ("g", "g", lambda a: a.mapped(lambda c: (c[1], c[0], *c[2:]))), "reverse": ("g", "g", lambda a: a.each_run(lambda r: r[::-1])), "translate": ("gnn/n", "g", lambda a, x, y, z=0.0: a.mapped(lambda c: (c[0] + x, c[1] + y, *([c[2] + z] if a.z else []), *c[2 + a.z :]))),
    "affine": ("gnnnnnn/nnnnnn", "g", _affine), "rotate": ("gn/*", "g", _rotated), "rotatez": ("gn", "g", _rotated), "rotatex": ("gn", "g", lambda a, t: _affine(a, 1, 0, 0, 0, math.cos(t), -math.sin(t), 0, math.sin(t), math.cos(t), 0, 0, 0)),
    "rotatey": ("gn", "g", lambda a, t: _affine(a, math.cos(t), 0, math.sin(t), 0, 1, 0, -math.sin(t), 0, math.cos(t), 0, 0, 0)), "scale": ("g*", "g", _scaled), "transscale": ("gnnnn", "g", lambda a, dx, dy, fx, fy: a.mapped(lambda c: ((c[0] + dx) * fx, (c[1] + dy) * fy, *c[2:]))),
    "snaptogrid": ("gn/nnn", "g", _snapped), "shiftlongitude": ("g", "g", lambda a: a.mapped(lambda c: (c[0] + 360 if c[0] < 0 else c[0] - 360 if c[0] > 180 else c[0], *c[1:]))), "wrapx": ("gnn", "g", _wrapped),
    "segmentize": ("gn", "g", lambda a, d: a.each_run(lambda r: g.segmentized(r, d))), "simplify": ("gn/t", "g", lambda a, d, _=False: a.each_run(lambda r: g.simplified(r, d))), "simplifyvw": ("gn", "g", lambda a, d: a.each_run(lambda r: g.without_small_triangles(r, d))),
    "chaikinsmoothing": ("g/it", "g", lambda a, n=1, _=False: a if n == 0 else FUNCTIONS["chaikinsmoothing"][2](a.each_run(g.smoothed), n - 1)), "removerepeatedpoints": ("g/n", "g", _without_repeats), "scroll": ("gg", "g", _scrolled),
    "addpoint": ("gg/i", "g", lambda a, p, at=-1: a.like("LINESTRING", _replaced(a.data, at, p.data, True))), "setpoint": ("gig", "g", lambda a, at, p: a.like("LINESTRING", _replaced(a.data, at, p.data))), "removepoint": ("gi", "g", lambda a, at: a.like("LINESTRING", _replaced(a.data, at, None))),
    "lineextend": ("gn/n", "g", _extended), "addmeasure": ("gnn", "g", _measured), "filterbym": ("gn/n", "g", lambda a, lo, hi=math.inf: a.each_run(lambda r: [c for c in r if lo <= c[-1] <= hi])),
    # along lines
    "lineinterpolatepoint": ("gn", "g", _line(lambda a, t: a.like("POINT", g.at_fraction(a.data, t)))), "lineinterpolatepoint3d": ("gn", "g", _line(lambda a, t: a.like("POINT", g.at_fraction(a.data, t, 2 + a.z)))), "lineinterpolatepoints": ("gn/t", "g", _line(_points_at)),
    "linelocatepoint": ("gg", "double", _line(lambda a, p: g.locate(a.data, p.data))), "linesubstring": ("gnn", "g", _line(lambda a, lo, hi: _run(a, g.substring(a.data, lo, hi)))), "interpolatepoint": ("gg", "double", _line(lambda a, p: g.at_fraction(a.data, g.locate(a.data, p.data))[-1])),
    "locatealong": ("gn/n", "g", lambda a, v, _=0.0: _along(a, v, v, 2 + a.z)), "locatebetween": ("gnn/n", "g", lambda a, lo, hi, _=0.0: _along(a, lo, hi, 2 + a.z)), "locatebetweenelevations": ("gnn", "g", lambda a, lo, hi: _along(a, lo, hi, 2)),
    "isvalidtrajectory": ("g", "boolean", lambda a: a.kind == "LINESTRING" and a.m and all(p[-1] < q[-1] for p, q in zip(a.data, a.data[1:], strict=False))),
    # text and binary
    "astext": ("g/i", "string", lambda a, _=15: g.to_text(a)), "asewkt": ("g/i", "string", lambda a, _=15: g.to_text(a, True)), "asbinary": ("g/s", "binary", lambda a, order="NDR": g.to_binary(a, order)), "asewkb": ("g/s", "binary", lambda a, order="NDR": g.to_binary(a, order, True)),
    "ashexewkb": ("g/s", "string", lambda a, order="NDR": g.to_binary(a, order, True).hex().upper()), "asgeojson": ("g/ii", "string", _json), "asgml": ("g/ii", "string", lambda a, d=15, _=0: _xml(a, "gml:", ",", " ", "gml", d)), "askml": ("g/is", "string", lambda a, d=15, _="": _xml(a, "", ",", " ", "kml", d)),
    "assvg": ("g/ii", "string", _svg), "geohash": ("g/i", "string", _geohash), "asencodedpolyline": ("g/i", "string", lambda a, n=5: g.to_polyline(a.coords(), n)), "aslatlontext": ("g/s", "string", _of_point(_degrees)),
    "geomfromtext": ("s/i", "g", _from_text), "geomfromewkt": ("s", "g", g.from_text), "geogfromtext": ("s", "g", lambda x: replace(a, srid=a.srid or 4326) if (a := g.from_text(x)) else a), "to_geometry": ("*", "g", lambda x: g.from_binary(x) if isinstance(x, bytes | bytearray) else x),
    "to_geography": ("*", "g", lambda x: replace(a, srid=a.srid or 4326) if (a := g.from_binary(x) if isinstance(x, bytes | bytearray) else x) else None), "geomfromwkb": ("b/i", "g", lambda b, s=0: replace(g.from_binary(b), srid=s)), "geomfromewkb": ("b", "g", g.from_binary), "geogfromwkb": ("b", "g", lambda b: g.from_binary(b, 4326)),
    "geomfromgeojson": ("s", "g", lambda s: g.from_json(json.loads(s))), "linefromencodedpolyline": ("s/i", "g", lambda s, n=5: Geometry("LINESTRING", g.from_polyline(s, n), 4326)),
    "pointfromgeohash": ("s/i", "g", lambda s, n=20: _point(((b := g.geohash_box(s[:n]))[0] / 2 + b[2] / 2, b[1] / 2 + b[3] / 2))), "geomfromgeohash": ("s/i", "g", lambda s, n=20: _rectangle(*g.geohash_box(s[:n]))),
    **{f"{n}fromtext": ("s/i", "g", _typed(k)) for n, k in (("point", "POINT"), ("line", "LINESTRING"), ("poly", "POLYGON"), ("polygon", "POLYGON"), ("mpoint", "MULTIPOINT"), ("multipoint", "MULTIPOINT"), ("mline", "MULTILINESTRING"), ("multilinestring", "MULTILINESTRING"), ("mpoly", "MULTIPOLYGON"), ("multipolygon", "MULTIPOLYGON"), ("geomcoll", "GEOMETRYCOLLECTION"))},
    **{f"{n}fromwkb": ("b/i", "g", _typed(k, True)) for n, k in (("point", "POINT"), ("line", "LINESTRING"), ("linestring", "LINESTRING"), ("poly", "POLYGON"), ("polygon", "POLYGON"), ("mpoint", "MULTIPOINT"), ("multipoint", "MULTIPOINT"), ("mline", "MULTILINESTRING"), ("multiline", "MULTILINESTRING"), ("mpoly", "MULTIPOLYGON"), ("multipoly", "MULTIPOLYGON"), ("geomcoll", "GEOMETRYCOLLECTION"))},
    # what has no effect on these geometries
    **{n: ("g", "g", lambda a: a) for n in ("postgis_noop", "postgis_geos_noop", "postgis_addbbox", "postgis_dropbbox")}, "postgis_hasbbox": ("g", "boolean", lambda a: a.kind != "POINT"),
    "geometry_cmp": ("gg", "bigint", lambda a, b: (a.coords() > b.coords()) - (a.coords() < b.coords())), "geography_cmp": ("gg", "bigint", lambda a, b: (a.coords() > b.coords()) - (a.coords() < b.coords())),
}
# Names whose functions need a library of topology, projections, curves or formats.
UNSUPPORTED = frozenset(
    "buffer buildarea cleangeometry clipbybox2d clusterintersecting clusterwithin concavehull coverageunion curvetoline delaunaytriangles difference forcecurve intersection inversetransformpipeline linemerge linetocurve makevalid "
    "minimumboundingcircle minimumclearance minimumclearanceline node offsetcurve orientedenvelope pointonsurface polygonize reduceprecision relate sharedpaths simplifypolygonhull simplifypreservetopology snap split subdivide symdifference "
    "symmetricdifference transform transformpipeline triangulatepolygon unaryunion union voronoilines voronoipolygons asmvtgeom astwkb asx3d asmarc21 geomfromtwkb geomfromgml geomfromkml geomfrommarc21 letters".split()
)


def _argument(x, kind: str):
    if x is None or kind not in "ga*":
        return int(x) if x is not None and kind == "i" else float(x) if x is not None and kind == "n" else x
    if isinstance(x, str):
        return _read(x)
    return [_read(v) for v in x if v is not None] if hasattr(x, "__len__") and not isinstance(x, bytes | bytearray) else float(x) if isinstance(x, int | float) else x


def _kinds(spec: str, n: int) -> str:
    flat = spec.replace("/", "")
    if "*" in flat:
        head = flat.split("*")[0]
        return (head + "*" * n)[:n]
    return flat[:n]


def _function(name: str):
    spec, result, f = FUNCTIONS[name]
    least = len(spec.split("/")[0].replace("*", "")) or 1

    def build(args: list[Column], named: dict, kind) -> Column:
        args = [*args, *named.values()]
        kinds = _kinds(spec, len(args))
        if not least <= len(args) <= (len(kinds) if "*" not in spec else 9):
            raise QueryError(f"no overload of 'postgis::{name}' takes {len(args)} arguments")

        def run(*values):
            if any(v is None for v in values):
                return None
            return _shown(f(*[_argument(v, k) for v, k in zip(values, kinds, strict=True)]))

        typed = [a.cast("double") if k == "n" else a.cast("bigint") if k == "i" else a for a, k in zip(args, kinds, strict=True)]
        return F.udf(run, "string" if result == "g" else result, useArrow=True)(*typed)

    return build


# --- boxes


def _bounds(text):
    b = None if text is None else g.box(_read(text))
    return None if b is None else dict(zip(("xmin", "ymin", "zmin", "xmax", "ymax", "zmax"), map(float, b), strict=True))


def box_of(c: Column, kind) -> Column:
    return c if isinstance(kind(c), T.StructType) else F.udf(_bounds, BOX, useArrow=True)(c)


def _box(*v) -> Column:
    return F.struct(*[x.cast("double").alias(n) for x, n in zip(v, ("xmin", "ymin", "zmin", "xmax", "ymax", "zmax"), strict=True)])


def _hit(n: int):
    def test(a, b):
        out = None
        for k in "xyz"[:n]:
            c = (a[f"{k}min"] <= b[f"{k}max"]) & (b[f"{k}min"] <= a[f"{k}max"])
            out = c if out is None else out & c
        return out

    return test


def _holds(n: int):
    def test(a, b):
        out = None
        for k in "xyz"[:n]:
            c = (a[f"{k}min"] <= b[f"{k}min"]) & (b[f"{k}max"] <= a[f"{k}max"])
            out = c if out is None else out & c
        return out

    return test


def _gap(a, b) -> Column:
    side = lambda k: F.greatest(a[f"{k}min"] - b[f"{k}max"], b[f"{k}min"] - a[f"{k}max"], F.lit(0.0))
    return F.sqrt(side("x") * side("x") + side("y") * side("y"))


def _middle_gap(n: int):
    def d(a, b):
        total = F.lit(0.0)
        for k in "xyz"[:n]:
            m = (a[f"{k}min"] + a[f"{k}max"] - b[f"{k}min"] - b[f"{k}max"]) / 2
            total = total + m * m
        return F.sqrt(total)

    return d


BOX_TESTS = {
    "op_left": lambda a, b: a["xmax"] < b["xmin"], "op_right": lambda a, b: a["xmin"] > b["xmax"], "op_below": lambda a, b: a["ymax"] < b["ymin"], "op_above": lambda a, b: a["ymin"] > b["ymax"],
    "op_overleft": lambda a, b: a["xmax"] <= b["xmax"], "op_overright": lambda a, b: a["xmin"] >= b["xmin"], "op_overbelow": lambda a, b: a["ymax"] <= b["ymax"], "op_overabove": lambda a, b: a["ymin"] >= b["ymin"],
    **{f"op_overlaps{s}": _hit(n) for s, n in (("", 2), ("_2d", 2), ("_3d", 3), ("_nd", 3))}, **{f"op_contains{s}": _holds(n) for s, n in (("", 2), ("_2d", 2), ("_3d", 3), ("_nd", 3))},
    **{n: (lambda f: lambda a, b: f(b, a))(_holds(k)) for n, k in (("op_within", 2), ("op_is_contained_2d", 2), ("op_contained_3d", 3), ("op_within_nd", 3))},
    **{f"op_same{s}": (lambda n: lambda a, b: _holds(n)(a, b) & _holds(n)(b, a))(n) for s, n in (("", 2), ("_3d", 3), ("_nd", 3))}, "op_neq": lambda a, b: ~(_holds(2)(a, b) & _holds(2)(b, a)),
    "op_distance_box": _gap, "op_distance_centroid": _middle_gap(2), "op_distance_centroid_nd": _middle_gap(3),
}


def _expanded(a, named, kind) -> Column:
    b, d = box_of(a[0], kind), [x.cast("double") for x in a[1:]]
    dx, dy, dz = (d[0], d[0], d[0]) if len(d) == 1 else (d[0], d[1], d[2] if len(d) > 2 else F.lit(0.0))
    out = _box(b["xmin"] - dx, b["ymin"] - dy, b["zmin"] - dz, b["xmax"] + dx, b["ymax"] + dy, b["zmax"] + dz)
    return out if isinstance(kind(a[0]), T.StructType) else _function("makeenvelope")([out["xmin"], out["ymin"], out["xmax"], out["ymax"]], {}, kind)


def _joined_box(a, named, kind) -> Column:
    x, y = (box_of(c, kind) for c in a[:2])
    low = [F.least(x[k], y[k]) for k in ("xmin", "ymin", "zmin")]
    return F.when(F.lit(True), _box(*low, *[F.greatest(x[k], y[k]) for k in ("xmax", "ymax", "zmax")]))


def _hash_box(a, named, kind) -> Column:
    def run(s):
        if s is None:
            return None
        x0, y0, x1, y1 = g.geohash_box(s)
        return {"xmin": x0, "ymin": y0, "zmin": 0.0, "xmax": x1, "ymax": y1, "zmax": 0.0}

    return F.udf(run, BOX, useArrow=True)(a[0])


def functions() -> dict:
    """All functions of the namespace by full name, as the standard library takes them."""
    out = {n: _function(n) for n in FUNCTIONS}
    out |= {n: (lambda f: lambda a, named, kind: f(box_of(a[0], kind), box_of(a[1], kind)))(f) for n, f in BOX_TESTS.items()}
    out |= {n: (lambda n: lambda a, named, kind: box_of(a[0], kind)[n])(n) for n in ("xmin", "ymin", "zmin", "xmax", "ymax", "zmax")}
    out |= {n: lambda a, named, kind: box_of(a[0], kind) for n in ("to_box2d", "to_box3d", "postgis_getbbox")}
    out |= {"expand": _expanded, "combinebbox": _joined_box, "makebox2d": _joined_box, "makebox3d": _joined_box, "box2dfromgeohash": _hash_box}

    def missing(name: str):
        def fail(a, named, kind):
            raise QueryError(f"'postgis::{name}' isn't supported: it needs a geometry library")

        return fail

    out |= {n: missing(n) for n in UNSUPPORTED}
    return {f"postgis::{n}": f for n, f in out.items()}


def _extent(c: Column, distinct: bool) -> Column:
    b = F.udf(_bounds, BOX, useArrow=True)(c)
    return F.struct(*[(F.min if n.endswith("min") else F.max)(b[n]).alias(n) for n in ("xmin", "ymin", "zmin", "xmax", "ymax", "zmax")])


def _of_all(f):
    def run(c: Column, distinct: bool) -> Column:
        one = lambda xs: None if xs is None or not len(xs) else _shown(f([_read(x) for x in xs]))
        return F.udf(one, "string", useArrow=True)(F.collect_list(c))

    return run


AGGREGATES = {"postgis::extent_agg": _extent, "postgis::extent3d_agg": _extent, "postgis::collect_agg": _of_all(_collected), "postgis::makeline_agg": _of_all(_made_line)}
