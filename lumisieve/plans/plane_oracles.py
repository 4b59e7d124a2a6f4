"""The steps on planes in plain SQL: places as rows, weights as tables, sums and windows."""

from __future__ import annotations

from ..functions.raster import DB4_LOW
from .oracles import _COS, _PIXELS, PLANES, digits, greater

START = f"WITH RECURSIVE {PLANES}, {_PIXELS}, p0 AS MATERIALIZED (SELECT vec_id, y, x, v::BIGINT AS v FROM p)"


def weights(name: str, sizes: str, target: int) -> str:
    """(n, k, s, w): what place s of n adds to place k of the target, in units of 2 ** -22."""
    sinc = lambda x: f"(CASE WHEN {x} = 0 THEN 1e0 ELSE sin(pi() * {x}) / (pi() * {x}) END)"
    return f"""{name}_p AS (SELECT n, k, (k + 0.5e0) * (n / {target}e0) AS middle, greatest(1e0, n / {target}e0) AS wide FROM (SELECT DISTINCT n::DOUBLE AS n FROM ({sizes})), range({target}) t(k)),
{name}_s AS (SELECT *, unnest(range(greatest(0, trunc(middle - 3e0 * wide + 0.5e0)::BIGINT), least(n::BIGINT, trunc(middle + 3e0 * wide + 0.5e0)::BIGINT))) AS s FROM {name}_p),
{name}_x AS (SELECT n, k, s, (s + 0.5e0 - middle) / wide AS q FROM {name}_s),
{name}_r AS (SELECT n, k, s, CASE WHEN abs(q) < 3 THEN {sinc('q')} * {sinc('(q / 3e0)')} ELSE 0e0 END AS r FROM {name}_x),
{name}_u AS (SELECT n, k, s, r / sum(r) OVER (PARTITION BY n, k) * 4194304e0 AS u FROM {name}_r),
{name} AS MATERIALIZED (SELECT n::BIGINT AS n, k, s, CAST(sign(u) * floor(abs(u) + 0.5e0) AS BIGINT) AS w FROM {name}_u)"""


_BYTE = "least(255, greatest(0, CAST(floor((sum(v * w) + 2097152) / 4194304e0) AS BIGINT)))"


def resized(name: str, source: str, n_w: int, n_h: int, t_w: int, t_h: int) -> str:
    """(vec_id, y, x, v) of another size."""
    return f"""{weights(f'{name}_wx', f'SELECT {n_w} AS n', t_w)}, {weights(f'{name}_wy', f'SELECT {n_h} AS n', t_h)},
{name}_a AS (SELECT vec_id, y, k AS x, {_BYTE} AS v FROM {source} JOIN {name}_wx ON s = x GROUP BY vec_id, y, k),
{name} AS MATERIALIZED (SELECT vec_id, k AS y, x, {_BYTE} AS v FROM {name}_a JOIN {name}_wy ON s = y GROUP BY vec_id, x, k)"""


def text(source: str, name: str, value: str = "v") -> str:
    return f"SELECT vec_id, string_agg({value}::VARCHAR, ',' ORDER BY y, x) AS {name} FROM {source} GROUP BY vec_id"


def _phash(n: int = 32) -> str:
    cos = lambda u, t: f"2e0 * cos(pi() * {u} * (2 * {t} + 1) / {2 * n}e0)"
    bits = lambda cut: digits([greater(f"l[{k + 1}]", f"{cut} + 1e-10") for k in range(64)])
    return f"""{START}, {resized('r', 'p0', 8, 8, n, n)},
a AS (SELECT vec_id, u, x, sum(v * {cos('u', 'y')}) AS v FROM r, range(8) t(u) GROUP BY vec_id, u, x),
b AS (SELECT vec_id, u, w, sum(v * {cos('w', 'x')}) AS v FROM a, range(8) t(w) GROUP BY vec_id, u, w),
c AS (SELECT vec_id, list(v ORDER BY u, w) AS l, median(v) AS cut FROM b GROUP BY vec_id),
d AS (SELECT vec_id, y, w, sum(v * {cos('w', 'x')}) AS v FROM r, range(1, 9) t(w) WHERE y < 8 GROUP BY vec_id, y, w),
e AS (SELECT vec_id, list(v ORDER BY y, w) AS l, sum(v) / 64e0 AS cut FROM d GROUP BY vec_id)
SELECT c.vec_id, {bits('c.cut').replace('l[', 'c.l[')} AS phash, {bits('e.cut').replace('l[', 'e.l[')} AS phash_simple FROM c JOIN e ON e.vec_id = c.vec_id"""


ROOT = "0.7071067811865476e0"


class Lists:
    """A chain of tables (vec_id, l), each list made of expressions over the one before."""

    def __init__(self, start: str, first: str):
        self.ctes, self.now, self.n = [start], first, 0

    def step(self, exprs: list[str], name: str | None = None) -> str:
        self.n += 1
        name = name or f"s{self.n}"
        self.ctes.append(f"{name} AS MATERIALIZED (SELECT vec_id, [{', '.join(exprs)}] AS l FROM {self.now})")
        self.now = name
        return name


def _at(side: int, y: int, x: int) -> str:
    return f"l[{y * side + x + 1}]"


def _haar(chain: Lists, side: int, name: str) -> str:
    """One level; the list has the four bands one after another: ll, lh, hl, hh."""
    h = side // 2
    pair = lambda a, b, sign: f"({a} * {ROOT} {sign} {b} * {ROOT})"
    chain.step([pair(_at(side, 2 * y, x), _at(side, 2 * y + 1, x), s) for s in "+-" for y in range(h) for x in range(side)])
    row = lambda part, y, x: f"l[{part * h * side + y * side + x + 1}]"
    return chain.step([pair(row(part, y, 2 * x), row(part, y, 2 * x + 1), s) for part in (0, 1) for s in "+-" for y in range(h) for x in range(h)], name)


def _tower(chain: Lists, side: int, prefix: str) -> None:
    """All levels, as tables prefix1, prefix2, ..."""
    k = 1
    while side > 1:
        _haar(chain, side, f"{prefix}{k}")
        side, k = side // 2, k + 1
        if side > 1:
            chain.step([f"l[{i + 1}]" for i in range(side * side)])


def _back(chain: Lists, side: int, prefix: str, levels: int, zero: bool) -> None:
    """From the last level's bands to the plane."""
    low = None
    for k in range(levels, 0, -1):
        h = side >> k
        n = h * h
        own = f"{prefix}{k}"
        name = f"{prefix}_in{k}_{int(zero)}"
        ll = [f"b.l[{i + 1}]" if low is None else f"a.l[{i + 1}]" for i in range(n)]
        if low is None and zero:
            ll = ["0e0"] * n
        rest = [f"b.l[{n + i + 1}]" for i in range(3 * n)]
        source = f"{own} b" if low is None else f"{low} a JOIN {own} b ON b.vec_id = a.vec_id"
        chain.ctes.append(f"{name} AS MATERIALIZED (SELECT b.vec_id, [{', '.join(ll + rest)}] AS l FROM {source})")
        chain.now = name
        band = lambda b, y, x: f"l[{b * n + y * h + x + 1}]"
        join = lambda a, b, s: f"({a} * {ROOT} {s} {b} * {ROOT})"
        chain.step([join(band(2 * part, y, x), band(2 * part + 1, y, x), s) for part in (0, 1) for y in range(h) for x in range(h) for s in "+-"])
        half = lambda part, y, x: f"l[{part * 2 * n + y * 2 * h + x + 1}]"
        low = chain.step([join(half(0, y, x), half(1, y, x), s) for y in range(h) for s in "+-" for x in range(2 * h)])


def _mirror(at: int, n: int) -> int:
    p = at % (2 * n)
    return min(p, 2 * n - 1 - p)


HIGH = [-v if k % 2 == 0 else v for k, v in enumerate(reversed(DB4_LOW))]


def _filtered(cells: list[str], taps) -> list[str]:
    n = len(cells)
    return ["(" + " + ".join(["0e0", *[f"{t!r}::DOUBLE * {cells[_mirror(2 * i + 1 - k, n)]}" for k, t in enumerate(taps)]]) + ")" for i in range((n + 7) // 2)]


_LIST = "g0 AS MATERIALIZED (SELECT vec_id, list(v::DOUBLE ORDER BY y, x) AS l FROM p0 GROUP BY vec_id)"


def _millionths(name: str) -> str:
    return f"array_to_string(list_transform({name}, lambda v: CAST(round(v * 1e6) AS BIGINT)), ',')"


def _wavelets() -> str:
    chain = Lists(f"{START}, {_LIST}", "g0")
    _tower(chain, 8, "h")
    _back(chain, 8, "h", 3, False)
    whole = chain.now
    _back(chain, 8, "h", 3, True)
    flat = chain.now
    chain.now = "g0"
    rows = [[_at(8, y, x) for x in range(8)] for y in range(8)]
    low = chain.step([v for r in rows for v in _filtered(r, DB4_LOW)])
    chain.now = "g0"
    high = chain.step([v for r in rows for v in _filtered(r, HIGH)])
    joined = []
    for y in range(8):
        for x in range(8):
            terms = [f"{taps[2 * i + 1 - x]!r}::DOUBLE * {t}.l[{y * 7 + i + 1}]" for t, taps in (("lo", DB4_LOW), ("hi", HIGH)) for i in range(x // 2, min(7, x // 2 + 4)) if 0 <= 2 * i + 1 - x < 8]
            joined.append("(" + " + ".join(["0e0", *terms]) + ")")
    return f"""{', '.join(chain.ctes)}
SELECT lo.vec_id, CAST(round(h3.l[1] * 1e6) AS BIGINT) AS coarsest, {_millionths('w.l')} AS whole, {_millionths('f.l')} AS flat, {_millionths('lo.l')} AS low, {_millionths('hi.l')} AS high,
  {_millionths('[' + ', '.join(joined) + ']')} AS joined
FROM {low} lo JOIN {high} hi ON hi.vec_id = lo.vec_id JOIN {whole} w ON w.vec_id = lo.vec_id JOIN {flat} f ON f.vec_id = lo.vec_id JOIN h3 ON h3.vec_id = lo.vec_id"""


def _whash(side: int = 16) -> str:
    chain = Lists(f"{START}, {resized('r', 'p0', 8, 8, side, side)}, g0 AS MATERIALIZED (SELECT vec_id, list(v / 255e0 ORDER BY y, x) AS l FROM r GROUP BY vec_id)", "g0")
    _tower(chain, side, "h")
    _back(chain, side, "h", side.bit_length() - 1, True)
    flat = chain.now
    _haar(chain, side, "haar")
    chain.now = flat
    columns = [[_at(side, y, x) for y in range(side)] for x in range(side)]
    chain.step([v for c in columns for v in _filtered(c, DB4_LOW)])  # a column's places one after another
    n = (side + 7) // 2
    chain.step([v for y in range(n) for v in _filtered([f"l[{x * n + y + 1}]" for x in range(side)], DB4_LOW)], "db4")
    of = lambda name, size, snap: digits([greater(f"{name}.l[{k + 1}]", f"{name}.cut + {snap}") for k in range(size)])
    cut = lambda name, n: f"{name}_c AS (SELECT vec_id, l[1:{n}] AS l, list_median(l[1:{n}]) AS cut FROM {name})"
    snapped = f"robust AS (SELECT vec_id, list_transform(l, lambda v: CASE WHEN abs(v) < 1e-12 THEN 0e0 ELSE v END) AS l FROM db4)"
    return f"""{', '.join(chain.ctes)}, {snapped}, {cut('haar', 64)}, {cut('db4', n * n)}, {cut('robust', n * n)}
SELECT a.vec_id, {of('a', 64, '0')} AS haar, {of('b', n * n, '1e-10')} AS db4, {of('c', n * n, '1e-10')} AS db4_robust
FROM haar_c a JOIN db4_c b ON b.vec_id = a.vec_id JOIN robust_c c ON c.vec_id = a.vec_id"""


def blurred(name: str, source: str) -> str:
    """Three passes of a box of radius 1 and a fraction along rows, then along columns."""
    radius, passes = 2.0, 3
    variance = radius * radius / passes
    box = 1 + 3 * (1 * 2 - 3 * variance) / (6 * (variance - 4))
    inner = int((1 << 24) / (box * 2 + 1))
    outer = ((1 << 24) - 3 * inner) // 2
    ctes, now = [], source
    for k in range(6):
        line, at = ("y", "x") if k < 3 else ("x", "y")
        near = "v + coalesce(lag(v) OVER w, v) + coalesce(lead(v) OVER w, v)"
        far = "coalesce(lag(v, 2) OVER w, first_value(v) OVER w) + coalesce(lead(v, 2) OVER w, last_value(v) OVER w)"
        own = name if k == 5 else f"{name}{k}"
        ctes.append(f"{own} AS MATERIALIZED (SELECT vec_id, y, x, (({near}) * {inner} + ({far}) * {outer} + 8388608) // 16777216 AS v FROM {now} WINDOW w AS (PARTITION BY vec_id, {line} ORDER BY {at} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))")
        now = own
    return ", ".join(ctes)


def median(name: str, source: str, side: int) -> str:
    edge = lambda c, d: f"least({side - 1}, greatest(0, a.{c} + {d}))"
    return f"""{name} AS MATERIALIZED (SELECT a.vec_id, a.y, a.x, list(b.v ORDER BY b.v)[5] AS v FROM {source} a, range(-1, 2) i(dy), range(-1, 2) j(dx)
  JOIN {source} b ON b.vec_id = a.vec_id AND b.y = {edge('y', 'dy')} AND b.x = {edge('x', 'dx')} GROUP BY a.vec_id, a.y, a.x)"""


def segments(source: str, side: int, least: int) -> str:
    """``seg`` (vec_id, segment, size, top, left, bottom, right)."""
    return f"""m AS (SELECT vec_id, y, x, v > 128 AS hill FROM {source}),
f AS (SELECT *, CASE WHEN hill = lag(hill) OVER (PARTITION BY vec_id, y ORDER BY x) THEN 0 ELSE 1 END AS fresh FROM m),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY vec_id, y ORDER BY x) AS k FROM f),
runs AS MATERIALIZED (SELECT vec_id, y, hill, min(x) AS x0, max(x) AS x1, min(y * {side} + x) AS pos FROM i GROUP BY vec_id, y, hill, k),
links AS MATERIALIZED (SELECT a.vec_id, a.pos AS a, b.pos AS b FROM runs a JOIN runs b ON a.vec_id = b.vec_id AND a.hill = b.hill AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1),
reached(vec_id, pos, other) AS (SELECT vec_id, pos, pos FROM runs UNION SELECT r.vec_id, r.pos, l.b FROM reached r JOIN links l ON l.vec_id = r.vec_id AND l.a = r.other),
firsts AS (SELECT vec_id, pos, min(other) AS first FROM reached GROUP BY vec_id, pos),
regions AS (SELECT r.vec_id, r.hill, first, sum(x1 - x0 + 1) AS size, min(y) AS top, min(x0) AS "left", max(y) AS bottom, max(x1) AS "right" FROM runs r JOIN firsts f ON f.vec_id = r.vec_id AND f.pos = r.pos GROUP BY r.vec_id, r.hill, first),
told AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY vec_id ORDER BY hill DESC, first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS met FROM regions),
seg AS MATERIALIZED (SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY hill DESC, first) - 1 AS segment, size, top, "left", bottom, "right" FROM told WHERE (hill OR {4 * side} + met < {side * side}) AND size > {least})"""


def _crops(side: int = 16, least: int = 12) -> str:
    place = lambda v: f"CAST(greatest(0, least(8, round_even(({v}) * (8 / {side}e0), 0))) AS BIGINT)"
    none = lambda c, whole: f"CASE WHEN s.vec_id IS NULL THEN {whole} ELSE {c} END"
    return f"""{START}, {resized('r', 'p0', 8, 8, side, side)}, {blurred('b', 'r')}, {median('d', 'b', side)}, {segments('d', side, least)},
boxes AS MATERIALIZED (SELECT e.vec_id, coalesce(segment, 0) AS segment, {place(none('s."left"', 0))} AS x0, {place(none('s.top', 0))} AS y0, {place(none('s."right" + 1', side))} AS x1, {place(none('s.bottom + 1', side))} AS y1
  FROM planes e LEFT JOIN seg s ON s.vec_id = e.vec_id),
cut AS MATERIALIZED (SELECT b.vec_id, b.segment, x1 - x0 AS w0, y1 - y0 AS h0, y - y0 AS y, x - x0 AS x, v FROM boxes b JOIN p0 p ON p.vec_id = b.vec_id AND p.y >= y0 AND p.y < y1 AND p.x >= x0 AND p.x < x1),
{weights('cx', 'SELECT w0 AS n FROM cut', 9)}, {weights('cy', 'SELECT h0 AS n FROM cut', 8)},
q AS (SELECT vec_id, segment, h0, y, k AS x, {_BYTE} AS v FROM cut JOIN cx ON cx.n = w0 AND s = x GROUP BY vec_id, segment, h0, y, k),
small AS (SELECT vec_id, segment, k AS y, x, {_BYTE} AS v FROM q JOIN cy ON cy.n = h0 AND s = y GROUP BY vec_id, segment, x, k),
l AS (SELECT vec_id, segment, list(v ORDER BY y, x) AS l FROM small GROUP BY vec_id, segment)
SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY segment) - 1)::INTEGER AS segment, {digits([greater(f'l[{y * 9 + x + 2}]', f'l[{y * 9 + x + 1}]') for y in range(8) for x in range(8)])} AS hex FROM l"""


ORACLES = {
    "resized_planes": f"""{START}, {resized('r', 'p0', 8, 8, 12, 5)}, {resized('s', 'r', 12, 5, 3, 7)}, a AS ({text('r', 'wide')}), b AS ({text('s', 'tall')})
      SELECT a.vec_id, wide, tall FROM a JOIN b ON a.vec_id = b.vec_id""",
    "dct_planes": f"""WITH {PLANES}, {_PIXELS}, a AS (SELECT vec_id, y, u, sum(v * {_COS.format(u='u', t='x')}) AS v FROM p, range(8) t(u) GROUP BY vec_id, y, u)
      SELECT vec_id, w::INTEGER AS y, u::INTEGER AS x, round(sum(v * {_COS.format(u='w', t='y')}) * 1000)::BIGINT AS thousandths FROM a, range(8) t(w) GROUP BY vec_id, w, u""",
    "phash_planes": _phash(),
    "haar_planes": f"""WITH {PLANES}, {_PIXELS} SELECT vec_id, (y // 2)::INTEGER AS y, (x // 2)::INTEGER AS x, sum(v)::BIGINT AS low, sum(v * (1 - 2 * (y % 2)))::BIGINT AS rows_differ,
      sum(v * (1 - 2 * (x % 2)))::BIGINT AS columns_differ, sum(v * (1 - 2 * (y % 2)) * (1 - 2 * (x % 2)))::BIGINT AS diagonal FROM p GROUP BY vec_id, y // 2, x // 2""",
    "wavelet_planes": _wavelets(),
    "whash_planes": _whash(),
    "blurred_planes": f"""{START}, {blurred('b', 'p0')}, {median('d', 'p0', 8)}, s AS ({text('b', 'blurred')}), t AS ({text('d', 'median')})
      SELECT s.vec_id, blurred, median FROM s JOIN t ON s.vec_id = t.vec_id""",
    "segment_planes": f"""{START}, {segments('p0', 8, 3)} SELECT vec_id, segment::INTEGER AS segment, size::BIGINT AS size, top::INTEGER AS top, "left"::INTEGER AS "left", bottom::INTEGER AS bottom, "right"::INTEGER AS "right" FROM seg""",
    "crop_resistant_planes": _crops(),
}
