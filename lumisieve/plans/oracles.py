"""The queries' results in plain SQL over the same tables, written apart from the Spark expressions."""

from __future__ import annotations


def digits(bits: list[str]) -> str:
    """The text of bits (SQL expressions of 0 or 1), padded in front to whole digits."""
    bits = ["0"] * (-len(bits) % 4) + bits
    return "(" + " || ".join(f"substr('0123456789abcdef', CAST(1 + 8*({a}) + 4*({b}) + 2*({c}) + ({d}) AS INTEGER), 1)" for a, b, c, d in zip(*[iter(bits)] * 4)) + ")"


def items(name: str, at) -> list[str]:
    return [f"{name}[{k + 1}]" for k in at]


def greater(a: str, b: str) -> str:
    return f"(CASE WHEN {a} > {b} THEN 1 ELSE 0 END)"


PLANES = """planes AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: CAST(least(255, greatest(0, floor((CAST(v AS DOUBLE) + 1.0) * 127.5))) AS INTEGER)) AS px FROM embeddings
)"""
AVERAGE = f"""{PLANES}, means AS (SELECT vec_id, label, px, list_sum(px) / 64.0 AS m FROM planes),
hashes AS (SELECT vec_id, label, {digits([greater(f"px[{k + 1}]", "m") for k in range(64)])} AS hex FROM means)"""


def distance(a: str, b: str, n: int) -> str:
    """Differing bits of two texts of ``n`` digits."""
    return "(" + " + ".join(f"bit_count(xor(CAST('0x' || substr({a}, {k}, {min(8, n + 1 - k)}) AS BIGINT), CAST('0x' || substr({b}, {k}, {min(8, n + 1 - k)}) AS BIGINT)))" for k in range(1, n + 1, 8)) + ")"


def _pixels(r: str, g: str, b: str, source: str) -> str:
    """CTEs up to ``judged``: l, h, s, v, colour_class and hue_bin of each row of ``source``, which has r, g, b."""
    return f"""rgb AS (SELECT *, greatest({r}, {g}, {b}) AS hi, least({r}, {g}, {b}) AS lo FROM {source}),
parts AS (SELECT *, CASE WHEN hi = lo THEN 1 ELSE hi - lo END AS span, (19595*{r} + 38470*{g} + 7471*{b} + 32768) // 65536 AS l,
  CASE WHEN hi = 0 THEN 0 ELSE (hi - lo) * 255 // greatest(hi, 1) END AS s FROM rgb),
turns AS (SELECT *, CASE WHEN {r} = hi THEN (hi-{b})*255//span - (hi-{g})*255//span
  WHEN {g} = hi THEN 510 + (hi-{r})*255//span - (hi-{b})*255//span ELSE 1020 + (hi-{g})*255//span - (hi-{r})*255//span END AS t FROM parts),
hues AS (SELECT *, CASE WHEN hi = lo THEN 0 WHEN t < 0 THEN (t + 1530) // 6 ELSE t // 6 END AS h FROM turns),
judged AS (SELECT *, CASE WHEN l < 32 THEN 'black' WHEN s < 85 THEN 'gray' WHEN s < 170 THEN 'faint' WHEN s > 170 THEN 'bright' ELSE 'none' END AS colour_class,
  CAST(least(5, h * 6 // 255) AS INTEGER) AS hue_bin FROM hues)"""


def _colour(bits: int = 3) -> str:
    top, names = (1 << bits) - 1, [f"{c}{k}" for c in ("faint", "bright") for k in range(6)]
    sums = ", ".join(f"coalesce(sum(CASE WHEN colour_class = '{n[:-1]}' AND hue_bin = {n[-1]} THEN m END), 0) AS {n}" for n in names)
    values = [f"CAST(least({top}, floor(CAST({c} AS DOUBLE) / total * {top + 1})) AS INTEGER)" for c in ("black", "gray")]
    values += [f"CAST(least({top}, floor(CAST({n} AS DOUBLE) * {top + 1} / greatest(1, total - black - gray))) AS INTEGER)" for n in names]
    encoded = digits([f"(CASE WHEN (v[{k + 1}] // {1 << (bits - i - 1)}) % {1 << (bits - i)} > 0 THEN 1 ELSE 0 END)" for k in range(14) for i in range(bits)])
    return f"""WITH codes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
exploded AS (SELECT doc_id, substr(x, k * 6 + 1, 6) AS p FROM (SELECT doc_id, x, unnest(range(0, length(x) // 6)) AS k FROM codes)),
grouped AS (SELECT doc_id, p, count(*) AS m FROM exploded GROUP BY doc_id, p),
source AS (SELECT doc_id, m, CAST('0x' || substr(p, 1, 2) AS BIGINT) AS r, CAST('0x' || substr(p, 3, 2) AS BIGINT) AS g, CAST('0x' || substr(p, 5, 2) AS BIGINT) AS b FROM grouped),
{_pixels('r', 'g', 'b', 'source')},
sums AS (SELECT doc_id, sum(m) AS total, coalesce(sum(CASE WHEN colour_class = 'black' THEN m END), 0) AS black, coalesce(sum(CASE WHEN colour_class = 'gray' THEN m END), 0) AS gray, {sums} FROM judged GROUP BY doc_id),
vals AS (SELECT doc_id, [{', '.join(values)}] AS v FROM sums)
SELECT doc_id, array_to_string(v, ',') AS bins, {encoded} AS hex FROM vals
UNION ALL SELECT doc_id, NULL, NULL FROM codes WHERE length(x) < 6"""


COPIES = """copies AS MATERIALIZED (SELECT vec_id AS id, hex FROM hashes UNION ALL SELECT vec_id + 1000000, substr(hex, 1, CAST(vec_id % 9 AS INTEGER))
  || translate(substr(hex, CAST(vec_id % 9 + 1 AS INTEGER), CAST(vec_id % 8 AS INTEGER)), '0123456789abcdef', '1032547698badcfe') || substr(hex, CAST(vec_id % 9 + vec_id % 8 + 1 AS INTEGER)) FROM hashes)"""
GOLDEN = "golden AS (SELECT label, arg_min(hex, vec_id) AS hex, min(vec_id) AS ordinal FROM hashes GROUP BY label)"
_QUARTERS = [[(y + dy) * 8 + x + dx for dy in range(4) for dx in range(4)] for y in (0, 4) for x in (0, 4)]


def _multi() -> str:
    means = ", ".join(f"({' + '.join(items('px', q))}) / 16.0 AS m{i}" for i, q in enumerate(_QUARTERS))
    own = ", ".join(digits([greater(f"px[{k + 1}]", f"m{i}") for k in q]) + f" AS o{i}" for i, q in enumerate(_QUARTERS))
    near = ", ".join("least(" + ", ".join(distance(f"a.o{i}", f"g.o{j}", 4) for j in range(4)) + f") AS d{i}" for i in range(4))
    matches = " + ".join(f"(CASE WHEN d{i} <= 4 THEN 1 ELSE 0 END)" for i in range(4))
    total = " + ".join(f"(CASE WHEN d{i} <= 4 THEN d{i} ELSE 0 END)" for i in range(4))
    return f"""WITH {PLANES}, m AS (SELECT vec_id, label, px, {means} FROM planes), q AS (SELECT vec_id, label, {own} FROM m),
first AS (SELECT label, min(vec_id) AS f FROM q GROUP BY label), g AS (SELECT q.* FROM q JOIN first ON q.label = first.label AND q.vec_id = first.f),
d AS (SELECT a.vec_id, a.o0, a.o1, a.o2, a.o3, {near} FROM q a JOIN g ON a.label = g.label),
s AS (SELECT *, CAST({matches} AS INTEGER) AS matches, CAST({total} AS INTEGER) AS distance FROM d)
SELECT vec_id, matches, distance, CASE WHEN matches = 0 THEN 4.0 ELSE CAST(4 AS DOUBLE) - (CAST(matches AS DOUBLE) - CAST(distance AS DOUBLE) / CAST(matches * 16 AS DOUBLE)) END AS score,
  matches >= 2 AS two_regions, o0 || ',' || o1 || ',' || o2 || ',' || o3 AS hex FROM s"""


def _multi_best() -> str:
    """Every vector with every golden one, as ``_multi`` with its own."""
    all_pairs = _multi().replace("ON a.label = g.label", "ON true").replace("SELECT a.vec_id,", "SELECT a.vec_id, g.vec_id AS ordinal,").replace("SELECT vec_id, matches,", "SELECT vec_id, ordinal, matches,")
    return f"""SELECT vec_id AS id, ordinal, score AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score, ordinal) AS k FROM ({all_pairs})) WHERE k = 1"""


_COS = "2 * cos(3.141592653589793 * {u} * ({t} * 2 + 1) / 16.0)"
_PIXELS = "p AS (SELECT vec_id, (k // 8)::INTEGER AS y, (k % 8)::INTEGER AS x, px[k + 1]::DOUBLE AS v FROM planes, range(64) t(k))"
_ONES = "list_sum(list_transform(string_split({t}, ''), lambda c: bit_count(CAST('0x' || c AS BIGINT))))"

_USER_HEX = "substr(md5(CAST(user_id AS VARCHAR)), 1, CAST(event_id % 16 AS INTEGER)) || translate(substr(md5(CAST(user_id AS VARCHAR)), CAST(event_id % 16 AS INTEGER) + 1, 1), '0123456789abcdef', '1032547698badcfe') || substr(md5(CAST(user_id AS VARCHAR)), CAST(event_id % 16 AS INTEGER) + 2, 15 - CAST(event_id % 16 AS INTEGER))"

ORACLES = {
    "average_hash": f"WITH {AVERAGE} SELECT vec_id, hex FROM hashes",
    "difference_hash": f"""WITH {PLANES} SELECT vec_id,
      {digits([greater(f"px[{y * 8 + x + 2}]", f"px[{y * 8 + x + 1}]") for y in range(8) for x in range(7)])} AS across,
      {digits([greater(f"px[{y * 8 + x + 9}]", f"px[{y * 8 + x + 1}]") for y in range(7) for x in range(8)])} AS down FROM planes""",
    "median_hash": f"""WITH {PLANES}, s AS (SELECT vec_id, px, list_sort(px) AS o FROM planes), m AS (SELECT vec_id, px, (o[32] + o[33]) / 2.0 AS median FROM s)
      SELECT vec_id, median, {digits([greater(f"px[{k + 1}]", "median + 1e-10") for k in range(64)])} AS hex FROM m""",
    "pixel_classes": f"""WITH source AS (SELECT l_orderkey % 256 AS r, l_partkey % 256 AS g, l_suppkey * 7 % 256 AS b FROM lineitem), {_pixels('r', 'g', 'b', 'source')}
      SELECT colour_class, hue_bin, count(*) AS n, CAST(sum(l) AS BIGINT) AS sum_l, CAST(sum(h) AS BIGINT) AS sum_h, CAST(sum(s) AS BIGINT) AS sum_s, CAST(sum(hi) AS BIGINT) AS sum_v FROM judged GROUP BY colour_class, hue_bin""",
    "alpha_composite": "SELECT CAST((l_orderkey % 256) * (l_partkey % 256) // 255 AS INTEGER) AS c, count(*) AS n FROM lineitem GROUP BY 1",
    "colour_hash": _colour(),
    "near_hash_pairs": f"""WITH {AVERAGE}, {COPIES}, v AS (SELECT DISTINCT hex FROM copies) SELECT a.hex AS a, b.hex AS b, CAST({distance('a.hex', 'b.hex', 16)} AS INTEGER) AS distance
      FROM v a JOIN v b ON a.hex < b.hex WHERE {distance('a.hex', 'b.hex', 16)} <= 6""",
    "near_hash_pairs_wide": f"""WITH {AVERAGE}, {COPIES}, v AS (SELECT DISTINCT hex FROM copies) SELECT a.hex AS a, b.hex AS b, CAST({distance('a.hex', 'b.hex', 16)} AS INTEGER) AS distance
      FROM v a JOIN v b ON a.hex < b.hex WHERE {distance('a.hex', 'b.hex', 16)} <= 12""",
    "near_hash_groups": f"""WITH RECURSIVE {AVERAGE}, {COPIES}, v AS MATERIALIZED (SELECT hex, min(id) AS first FROM copies GROUP BY hex),
      links AS MATERIALIZED (SELECT a.first AS x, b.first AS y FROM v a JOIN v b ON a.hex <> b.hex WHERE {distance('a.hex', 'b.hex', 16)} <= 6),
      reached(x, y) AS (SELECT first, first FROM v UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y),
      g AS (SELECT x, min(y) AS group_id FROM reached GROUP BY x)
      SELECT c.id, c.hex, g.group_id FROM copies c JOIN v ON v.hex = c.hex JOIN g ON g.x = v.first""",
    "best_match": f"""WITH {AVERAGE}, {GOLDEN}, d AS (SELECT h.vec_id AS id, h.hex, g.ordinal, CAST({distance('h.hex', 'g.hex', 16)} AS INTEGER) AS distance FROM hashes h CROSS JOIN golden g),
      r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, ordinal) AS k FROM d) SELECT id, hex, ordinal, distance FROM r WHERE k = 1""",
    "tolerance_filter": f"""WITH {AVERAGE}, {GOLDEN} SELECT h.vec_id, CAST({distance('h.hex', 'g.hex', 16)} AS INTEGER) AS distance, {distance('h.hex', 'g.hex', 16)} <= 20 AS near
      FROM hashes h JOIN golden g ON h.label = g.label""",
    "known_hashes": f"""WITH {AVERAGE}, {GOLDEN}, k AS (SELECT h.label, h.hex IN (SELECT hex FROM golden) AS known FROM hashes h)
      SELECT label, CASE WHEN known THEN 'known' ELSE 'new' END AS kind, count(*) AS n FROM k GROUP BY label, known""",
    "multi_hash": _multi(),
    "hex_parsers": f"""WITH m AS (SELECT o_orderkey, substr(md5('h' || CAST(o_orderkey AS VARCHAR)), 1, CAST(o_orderkey % 33 AS INTEGER)) AS x FROM orders),
      t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN upper(x) ELSE x END AS t FROM m),
      k AS (SELECT o_orderkey, t, length(t) > 0 AND lower(t) = t AS ok, CAST(floor(sqrt(length(t) * 4)) AS INTEGER) AS side FROM t),
      s AS (SELECT o_orderkey, t, ok, CASE WHEN ok AND side * side = length(t) * 4 THEN side ELSE -1 END AS side FROM k)
      SELECT o_orderkey, side, CAST(CASE WHEN side >= 0 THEN {_ONES.format(t='t')} ELSE -1 END AS INTEGER) AS ones,
        CAST(CASE WHEN ok AND length(t) >= 11 THEN {_ONES.format(t="substr(t, -10)")} + bit_count(CAST('0x' || substr(t, -11, 1) AS BIGINT) & 3) ELSE -1 END AS INTEGER) AS flat_ones,
        CASE WHEN side >= 0 THEN 2 ELSE -1 END AS parts FROM s""",
    "bin_bits": f"""SELECT v, {digits([f"(CASE WHEN (v // {1 << (3 - i)}) % {1 << (4 - i)} > 0 THEN 1 ELSE 0 END)" for i in range(4)])} AS digit, count(*) AS n FROM (SELECT CAST(l_orderkey % 16 AS INTEGER) AS v FROM lineitem) GROUP BY 1, 2""",
    "frame_changes": f"""WITH {AVERAGE}, f AS (SELECT vec_id, hex, lag(hex) OVER (PARTITION BY label ORDER BY vec_id) AS prior FROM hashes)
      SELECT vec_id, CAST(CASE WHEN prior IS NULL THEN -1 ELSE {distance('hex', 'prior', 16)} END AS INTEGER) AS change FROM f""",
    "hash_report": f"""WITH {AVERAGE}, c AS (SELECT label, substr(hex, 1, 1) >= '8' AS bright_corner, hex FROM hashes)
      SELECT coalesce(label, -1) AS label, coalesce(CAST(bright_corner AS VARCHAR), 'all') AS bright_corner, count(*) AS n, count(DISTINCT hex) AS n_hashes FROM c GROUP BY CUBE (label, bright_corner)""",
    "hash_set_ops": f"""WITH {AVERAGE}, e AS (SELECT DISTINCT substr(hex, 1, 2) AS prefix FROM hashes WHERE vec_id % 2 = 0), o AS (SELECT DISTINCT substr(hex, 1, 2) AS prefix FROM hashes WHERE vec_id % 2 = 1)
      SELECT prefix, CASE WHEN prefix IN (SELECT prefix FROM o) THEN 'both' ELSE 'even' END AS kind FROM e""",
    "largest_lines": r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), e'\n')) AS line, generate_subscripts(string_split(coalesce(text, ''), e'\n'), 1) - 1 AS ordinal FROM documents),
      r AS (SELECT doc_id, CAST(ordinal AS BIGINT) AS ordinal, CAST(length(line) AS BIGINT) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY length(line) DESC, ordinal) AS rank FROM l)
      SELECT doc_id, ordinal, size, rank FROM r WHERE rank <= 3""",
    "image_formats": """WITH p AS (SELECT p_partkey, p_partkey % 8 AS k, CAST(p_size AS BIGINT) + 1 AS w, p_partkey % 3000 + 1 AS h FROM part),
      f AS (SELECT p_partkey, ['bmp', 'png', 'gif', 'jpeg', 'webp', 'tiff', 'heic', NULL][k + 1] AS format, k <> 7 AS sized, w, h FROM p)
      SELECT p_partkey, format, CASE WHEN sized THEN w ELSE -1 END AS width, CASE WHEN sized THEN h ELSE -1 END AS height,
        CASE WHEN format IS NULL THEN 'unsupportedFormat' WHEN sized AND w * h > 100000 THEN 'imageTooLarge' ELSE 'none' END AS error_kind FROM f""",
    "decoded_average_hash": f"WITH {AVERAGE} SELECT vec_id, hex FROM hashes",
    "decoded_formats": f"""WITH {AVERAGE}, k AS (SELECT vec_id, hex, ['bmp24', 'bmp32', 'palette', 'bitfields', 'runs', 'tiff', 'cut', 'depth', 'os2', 'planes'][vec_id % 10 + 1] AS encoding FROM hashes)
      SELECT vec_id, encoding, CASE WHEN encoding = 'tiff' THEN 'tiff' ELSE 'bmp' END AS format,
        CASE encoding WHEN 'cut' THEN 'truncated' WHEN 'depth' THEN 'unsupportedFeature' WHEN 'os2' THEN 'unsupportedFeature' WHEN 'planes' THEN 'corruptInput' ELSE 'none' END AS fault,
        CASE WHEN vec_id % 10 < 6 THEN hex END AS hex FROM k""",
    "stream_windows": "SELECT time_bucket(INTERVAL '10 minutes', ts) AS window_start, count(*) AS n, count(DISTINCT event_type) AS n_hashes FROM events GROUP BY 1",
    "stream_sliding": "SELECT time_bucket(INTERVAL '15 minutes', ts) - k * INTERVAL '15 minutes' AS window_start, count(*) AS n FROM events, range(4) t(k) GROUP BY 1",
    "stream_first_seen": "SELECT DISTINCT substr(md5(event_type), 1, 16) || CAST(user_id AS VARCHAR) AS hex FROM events",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '90 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
      SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '90 minutes' AS session_end, count(*) AS n FROM s GROUP BY user_id, k""",
    "best_multi_match": _multi_best(),
    "hash_checks": f"""WITH {AVERAGE}, b AS (SELECT vec_id, hex, list_transform(string_split(hex, ''), lambda c: CAST('0x' || c AS BIGINT)) AS d FROM hashes)
      SELECT vec_id, 64 AS bits, true AS valid, vec_id % 3 = 2 OR (vec_id % 3 = 0 AND hex = repeat('0', 16)) AS broken_valid,
        {digits([f"((d[{i // 8 * 2 + 1 + (7 - i % 8) // 4}] >> {3 - (7 - i % 8) % 4}) & 1)" for i in range(64)])} AS old FROM b""",
    "stream_near_copies": f"""WITH e AS MATERIALIZED (SELECT event_id AS id, ts, {_USER_HEX} AS hex FROM events)
      SELECT a.id, b.id AS earlier_id, CAST({distance('a.hex', 'b.hex', 16)} AS INTEGER) AS distance FROM e a JOIN e b ON b.ts <= a.ts AND b.ts >= a.ts - INTERVAL '1 day' AND (b.ts < a.ts OR b.id < a.id)
      WHERE {distance('a.hex', 'b.hex', 16)} <= 2""",
    "stream_known": f"""WITH e AS MATERIALIZED (SELECT event_id AS id, {_USER_HEX} AS hex FROM events),
      k AS MATERIALIZED (SELECT min(event_id) AS ordinal, substr(md5(CAST(user_id AS VARCHAR)), 1, 16) AS hex FROM events WHERE user_id % 7 = 0 GROUP BY user_id)
      SELECT e.id, k.ordinal, CAST({distance('e.hex', 'k.hex', 16)} AS INTEGER) AS distance FROM e, k WHERE {distance('e.hex', 'k.hex', 16)} <= 1""",
    "stream_followed": """SELECT a.user_id, a.event_id AS id, b.event_id AS after_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL '6 hours'
      WHERE a.event_type = 'view' AND b.event_type = 'purchase'""",
    "asof_frames": f"""WITH h AS (SELECT event_id, user_id, ts, event_type, substr(md5(props), 1, 16) AS hex FROM events),
      j AS (SELECT a.event_id, a.hex, b.event_id AS reference, b.hex AS other FROM (SELECT * FROM h WHERE event_type = 'view') a ASOF LEFT JOIN (SELECT * FROM h WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND a.ts >= b.ts)
      SELECT event_id, coalesce(reference, -1) AS reference, CAST(CASE WHEN other IS NULL THEN -1 ELSE {distance('hex', 'other', 16)} END AS INTEGER) AS distance FROM j""",
    "hash_sketches": f"""WITH {AVERAGE}, c AS (SELECT label, substr(hex, 1, 1) >= '8' AS bright_corner, hex FROM hashes)
      SELECT coalesce(label, -1) AS label, coalesce(CAST(bright_corner AS VARCHAR), 'all') AS bright_corner, count(DISTINCT hex) AS n_hashes, true AS within_bound FROM c GROUP BY CUBE (label, bright_corner)""",
}
