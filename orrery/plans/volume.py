"""Queries of the volume operators on the bound tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..model import AXES, as_voxel_type, in_box
from ..operators import volume as V
from .bindings import DIMS, EMB, VOL, embedding_volume, lineitem_volumes, volume

Q, S = {}, {}
BOX = (0.0, 0.0, 0.0, 6.0, 15.0, 15.0)


def add(name, query, sql):
    Q[name], S[name] = query, sql


def rounded(df, *cols, n=6):
    return df.withColumns({c: F.round(c, n) for c in cols or ("value",)})


def minimum_slice(spark, d):
    v = lineitem_volumes(spark, d)
    n = V.normalize(v.select(*AXES, F.col("a").alias("value")), 0, 1)
    m = V.combine(n, v.select(*AXES, F.col("r").alias("value")), "mask")
    return rounded(V.stats(m.filter(in_box((1, 0, 0, 5, 15, 11)))), "min", "max", "mean", "std")


add("volume_minimum_slice", minimum_slice, f"""WITH {VOL}, n AS (SELECT *, (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) AS v FROM vol)
SELECT round(min(w), 6) AS min, round(max(w), 6) AS max, round(avg(w), 6) AS mean, round(stddev_pop(w), 6) AS std, count(*) AS n
FROM (SELECT CASE WHEN r <> 0 THEN v ELSE 0.0 END AS w FROM n WHERE x BETWEEN 1 AND 5 AND z BETWEEN 0 AND 11)""")

for op, sql in {"add": "a + b", "subtract": "a - b", "difference": "abs(a - b)", "average": "(a + b) / 2"}.items():
    add(f"vol_{op}", lambda s, d, op=op: V.combine(volume(s, d, "a"), volume(s, d, "b"), op), f"WITH {VOL} SELECT x, y, z, {sql} AS value FROM vol")
for op, sql in {"mask": "r <> 0", "inverse_mask": "r = 0"}.items():
    add(f"vol_{op}", lambda s, d, op=op: V.combine(volume(s, d, "a"), volume(s, d, "r"), op), f"WITH {VOL} SELECT x, y, z, CASE WHEN {sql} THEN a ELSE 0.0 END AS value FROM vol")

add("vol_scale", lambda s, d: V.scale(volume(s, d), 0.5), f"WITH {VOL} SELECT x, y, z, a * 0.5 AS value FROM vol")
add("vol_negate", lambda s, d: V.negate(volume(s, d)), f"WITH {VOL} SELECT x, y, z, -a AS value FROM vol")
add("vol_clip", lambda s, d: V.clip(volume(s, d), 800), f"WITH {VOL} SELECT x, y, z, CASE WHEN a < 800 THEN a ELSE 0.0 END AS value FROM vol")
add("vol_clamp_min", lambda s, d: V.clamp_min(volume(s, d), 700), f"WITH {VOL} SELECT x, y, z, CASE WHEN a < 700 THEN 700.0 ELSE a END AS value FROM vol")
add("vol_normalize", lambda s, d: rounded(V.normalize(volume(s, d), 0, 255), n=4), f"WITH {VOL} SELECT x, y, z, round((a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) * 255, 4) AS value FROM vol")
add("vol_map_embeddings", lambda s, d: rounded(V.normalize(embedding_volume(s, d), -1, 1), n=5), f"WITH {EMB} SELECT x, y, z, round(-1 + (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) * 2, 5) AS value FROM emb")
# sums grow with the table, and the SQL has no range
add("voxel_type_uchar", lambda s, d: volume(s, d).withColumn("value", as_voxel_type(F.col("value") / 97, "uchar", outside="keep")), f"WITH {VOL} SELECT x, y, z, trunc(a / 97)::BIGINT AS value FROM vol")
add("voxel_get", lambda s, d: V.get(volume(s, d), (3, 4, 5), DIMS), f"WITH {VOL} SELECT a AS value FROM vol WHERE x = 3 AND y = 4 AND z = 5")
add("voxel_linear_get", lambda s, d: volume(s, d).select((F.col("x") + F.col("y") * 7 + F.col("z") * 112).alias("i"), "value").filter("i between 100 and 199"), f"WITH {VOL} SELECT x + y * 7 + z * 112 AS i, a AS value FROM vol WHERE x + y * 7 + z * 112 BETWEEN 100 AND 199")
add("voxel_set", lambda s, d: V.put(volume(s, d), (1, 2, 3), -5), f"WITH {VOL} SELECT x, y, z, CASE WHEN x = 1 AND y = 2 AND z = 3 THEN -5.0 ELSE a END AS value FROM vol")
add("vol_fill", lambda s, d: V.fill(volume(s, d), 7), f"WITH {VOL} SELECT x, y, z, 7.0::DOUBLE AS value FROM vol")
add("vol_fillsub", lambda s, d: V.fill(volume(s, d), 9, (1, 2, 3, 4, 5, 6)), f"WITH {VOL} SELECT x, y, z, CASE WHEN x BETWEEN 1 AND 4 AND y BETWEEN 2 AND 5 AND z BETWEEN 3 AND 6 THEN 9.0 ELSE a END AS value FROM vol")
add("vol_sub_window", lambda s, d: V.sub(volume(s, d), (2, 4, 6, 5, 9, 12)), f"WITH {VOL} SELECT x - 2 AS x, y - 4 AS y, z - 6 AS z, a AS value FROM vol WHERE x BETWEEN 2 AND 5 AND y BETWEEN 4 AND 9 AND z BETWEEN 6 AND 12")
add("vol_sub_box", lambda s, d: V.sub_box(volume(s, d), (1.5, 2.0, 3.5, 4.0, 8.2, 9.0), BOX, DIMS), f"WITH {VOL} SELECT x - 2 AS x, y - 2 AS y, z - 4 AS z, a AS value FROM vol WHERE x BETWEEN 2 AND 4 AND y BETWEEN 2 AND 8 AND z BETWEEN 4 AND 9")
add("vol_slice", lambda s, d: V.extract_slice(volume(s, d), "z", 5), f"WITH {VOL} SELECT x AS u, y AS v, a AS value FROM vol WHERE z = 5")
add("vol_downsample", lambda s, d: V.downsample(volume(s, d), 3), f"WITH {VOL} SELECT x // 3 AS x, y // 3 AS y, z // 3 AS z, a AS value FROM vol WHERE x % 3 = 0 AND y % 3 = 0 AND z % 3 = 0")
add("vol_rgba_merge", lambda s, d: V.rgba_merge(*(volume(s, d, c) for c in "abra")), f"WITH {VOL} SELECT x * 4 + k AS x, y, z, CASE k WHEN 1 THEN b WHEN 2 THEN r ELSE a END AS value FROM vol, range(4) t(k)")
add("vol_composite_add", lambda s, d: V.composite(volume(s, d, "a"), volume(s, d, "b"), (2, 3, 4), "add"), f"WITH {VOL} SELECT v.x, v.y, v.z, v.a + coalesce(w.b, 0.0) AS value FROM vol v LEFT JOIN vol w ON v.x = w.x + 2 AND v.y = w.y + 3 AND v.z = w.z + 4")

STATS = "round(min({v}), 6) AS min, round(max({v}), 6) AS max, round(avg({v}), 6) AS mean, round(stddev_pop({v}), 6) AS std, count({v}) AS n"
stats = lambda v: rounded(V.stats(v), "min", "max", "mean", "std")
add("vol_stats", lambda s, d: stats(volume(s, d)), f"WITH {VOL} SELECT {STATS.format(v='a')} FROM vol")
add("vol_stats_embeddings", lambda s, d: rounded(V.stats(embedding_volume(s, d)), "min", "max", "mean", "std", n=5), f"WITH {EMB} SELECT {STATS.format(v='value').replace(', 6)', ', 5)')} FROM emb")
add("vol_stats_region", lambda s, d: rounded(V.stats_in_box(volume(s, d), (0.5, 3, 3, 4.5, 9, 9), BOX, DIMS), "min", "max", "mean", "std"), f"WITH {VOL} SELECT {STATS.format(v='a')} FROM vol WHERE x BETWEEN 0.5 AND 4.5 AND y BETWEEN 3 AND 9 AND z BETWEEN 3 AND 9")
add("vol_stats_empty_region", lambda s, d: V.stats_in_box(volume(s, d), (50, 50, 50, 60, 60, 60), BOX, DIMS), "SELECT 0.0::DOUBLE AS min, 0.0::DOUBLE AS max, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS std, 0::BIGINT AS n")
add("vol_min_max_window", lambda s, d: volume(s, d).filter(in_box((1, 1, 1, 3, 9, 9))).agg(F.min("value").alias("min"), F.max("value").alias("max")), f"WITH {VOL} SELECT min(a) AS min, max(a) AS max FROM vol WHERE x BETWEEN 1 AND 3 AND y BETWEEN 1 AND 9 AND z BETWEEN 1 AND 9")
add("vol_histogram", lambda s, d: V.histogram(volume(s, d), 32), f"""WITH {VOL}, e AS (SELECT min(a) lo, max(a) hi FROM vol),
h AS (SELECT least(31, floor((a - lo) / (hi - lo) * 32))::INT AS bin, count(*) AS n FROM vol, e GROUP BY 1)
SELECT i::INT AS bin, coalesce(n, 0) AS n FROM range(32) t(i) LEFT JOIN h ON h.bin = i""")
add("vol_robust_range", lambda s, d: rounded(V.robust_range(volume(s, d)), "low", "high"), f"WITH {VOL} SELECT round(quantile_cont(a, 0.02), 6) AS low, round(quantile_cont(a, 0.98), 6) AS high FROM vol")

NEIGHBOURS = ", ".join(f"coalesce(lag(a) OVER w{k}, a) AS {k}m, coalesce(lead(a) OVER w{k}, a) AS {k}p" for k in "xyz")
WINDOWS = "WINDOW wx AS (PARTITION BY y, z ORDER BY x), wy AS (PARTITION BY x, z ORDER BY y), wz AS (PARTITION BY x, y ORDER BY z)"
add("vol_gradient", lambda s, d: V.gradient(volume(s, d)), f"WITH {VOL} SELECT x, y, z, a AS value, (xp - xm) / 2 AS gx, (yp - ym) / 2 AS gy, (zp - zm) / 2 AS gz FROM (SELECT x, y, z, a, {NEIGHBOURS} FROM vol {WINDOWS})")
add("vol_diffusion", lambda s, d: rounded(V.diffusion(V.scale(volume(s, d, "b"), 0.25), 1)), f"""WITH {VOL}, q AS (SELECT x, y, z, b * 0.25 AS a FROM vol), n AS (SELECT x, y, z, a, {NEIGHBOURS} FROM q {WINDOWS})
SELECT x, y, z, round(a + 0.16 * ({' + '.join(f'exp(-((({c} - a) / 3.0) * (({c} - a) / 3.0))) * ({c} - a)' for c in ('xm', 'xp', 'ym', 'yp', 'zm', 'zp'))}), 6) AS value FROM n""")
add("vol_local_maxima", lambda s, d: V.local_maxima(volume(s, d)), f"WITH {VOL} SELECT v.x, v.y, v.z, v.a AS value FROM vol v JOIN vol w ON abs(v.x - w.x) <= 1 AND abs(v.y - w.y) <= 1 AND abs(v.z - w.z) <= 1 GROUP BY ALL HAVING max(w.a) <= v.a")
add("vol_bilateral", lambda s, d: rounded(V.bilateral(volume(s, d), 40, 1.5, 1), n=4), f"""WITH {VOL}, e AS (SELECT min(a) lo, max(a) hi FROM vol),
p AS (SELECT v.x, v.y, v.z, w.a AS o, floor(abs(w.a - v.a) * 255 / (hi - lo)) AS st, (v.x - w.x) * (v.x - w.x) + (v.y - w.y) * (v.y - w.y) + (v.z - w.z) * (v.z - w.z) AS d2
  FROM vol v JOIN vol w ON abs(v.x - w.x) <= 1 AND abs(v.y - w.y) <= 1 AND abs(v.z - w.z) <= 1, e)
SELECT x, y, z, round(sum(exp(-(st * st) / 3200.0) * exp(-d2 / 4.5) * o) / sum(exp(-(st * st) / 3200.0) * exp(-d2 / 4.5)), 4) AS value FROM p GROUP BY x, y, z""")
add("vol_ssim", lambda s, d: rounded(V.ssim(V.normalize(volume(s, d, "a"), 0, 255), V.normalize(volume(s, d, "b"), 0, 255)), "ssim"), f"""WITH {VOL}, n AS (SELECT x, y, z, (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) * 255 AS p, (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) * 255 AS q FROM vol),
m AS (SELECT sum(w) w, sum(w * p) p, sum(w * q) q, sum(w * p * p) pp, sum(w * q * q) qq, sum(w * p * q) pq FROM (
  SELECT v.x, v.y, v.z, o.p, o.q, exp(-((v.x - o.x) * (v.x - o.x) + (v.y - o.y) * (v.y - o.y) + (v.z - o.z) * (v.z - o.z)) / 4.5) AS w
  FROM n v JOIN n o ON abs(v.x - o.x) <= 1 AND abs(v.y - o.y) <= 1 AND abs(v.z - o.z) <= 1) GROUP BY x, y, z),
k AS (SELECT p / w AS mp, q / w AS mq, pp / w AS pp, qq / w AS qq, pq / w AS pq FROM m)
SELECT round(avg((2 * mp * mq + 6.5025) * (2 * (pq - mp * mq) + 58.5225) / ((mp * mp + mq * mq + 6.5025) * (pp - mp * mp + qq - mq * mq + 58.5225))), 6) AS ssim FROM k""")

TRILINEAR = """WITH {vol}, p AS ({points}), t AS (SELECT p.*, i, j, k, least(floor(px), {mx})::BIGINT AS bx, least(floor(py), 14)::BIGINT AS by_, least(floor(pz), 14)::BIGINT AS bz FROM p, range(2) a(i), range(2) b(j), range(2) c(k)),
w AS (SELECT *, (CASE i WHEN 1 THEN px - bx ELSE 1 - px + bx END) * (CASE j WHEN 1 THEN py - by_ ELSE 1 - py + by_ END) * (CASE k WHEN 1 THEN pz - bz ELSE 1 - pz + bz END) AS w FROM t)
SELECT {keys}, round(sum(w * a), 5) AS value FROM w JOIN vol v ON v.x = bx + i AND v.y = by_ + j AND v.z = bz + k GROUP BY ALL"""
add("vol_resize", lambda s, d: rounded(V.resize(volume(s, d), DIMS, (5, 9, 6)), n=5), TRILINEAR.format(vol=VOL, mx=5, keys="ox AS x, oy AS y, oz AS z", points="SELECT o.i AS ox, q.i AS oy, r.i AS oz, o.i * (6 / 4.0::DOUBLE) AS px, q.i * (15 / 8.0::DOUBLE) AS py, r.i * (15 / 5.0::DOUBLE) AS pz FROM range(5) o(i), range(9) q(i), range(6) r(i)"))
add("vol_interpolate", lambda s, d: rounded(V.interpolate(volume(s, d), s.range(200).select("id", (F.col("id") % 13 / 2.2).alias("wx"), (F.col("id") % 29 / 2).alias("wy"), (F.col("id") % 31 / 2.1).alias("wz")), BOX, DIMS, "id"), n=5), TRILINEAR.format(vol=VOL, mx=5, keys="id", points="SELECT i AS id, (i % 13) / 2.2::DOUBLE AS px, (i % 29) / 2.0::DOUBLE AS py, (i % 31) / 2.1::DOUBLE AS pz FROM range(200) u(i)"))
add("vol_rotate_z", lambda s, d: rounded(V.rotate_z(volume(s, d), 30, DIMS), n=4), f"""WITH {VOL}, t AS (SELECT x, y, z, round((x - 3) * cos(radians(-30)) - (y - 7.5::DOUBLE) * sin(radians(-30)) + 3, 9) AS px,
  round((x - 3) * sin(radians(-30)) + (y - 7.5::DOUBLE) * cos(radians(-30)) + 7.5::DOUBLE, 9) AS py FROM vol),
w AS (SELECT t.x, t.y, t.z, sum(v.a * (1 - abs(px - v.x)) * (1 - abs(py - v.y))) AS s FROM t JOIN vol v ON v.z = t.z AND abs(px - v.x) < 1 AND abs(py - v.y) < 1 WHERE px BETWEEN 0 AND 6 AND py BETWEEN 0 AND 15 GROUP BY ALL)
SELECT x, y, z, round(coalesce(s, 0.0), 4) AS value FROM vol LEFT JOIN w USING (x, y, z)""")


def projected(angles):
    """SQL of the ray sums ``pr`` at some angles."""
    r = math.hypot(6, 15) / 2
    rays = ", ".join(f"({k}, {math.cos(math.radians(a))!r}::DOUBLE, {math.sin(math.radians(a))!r}::DOUBLE)" for k, a in enumerate(angles))
    return f"""WITH {VOL}, rays(angle, c, s) AS (VALUES {rays}),
p AS (SELECT angle, u, oz, (u - 3) * c - (k - {r!r}::DOUBLE) * s + 3 AS px, (u - 3) * s + (k - {r!r}::DOUBLE) * c + 7.5::DOUBLE AS py FROM rays, range(7) d(u), range(16) e(oz), range({int(2 * r) + 1}) f(k)),
pr AS (SELECT angle, u, oz AS z, sum(a * (1 - abs(px - x)) * (1 - abs(py - y))) AS value FROM p JOIN vol ON z = oz AND abs(px - x) < 1 AND abs(py - y) < 1 WHERE px BETWEEN 0 AND 6 AND py BETWEEN 0 AND 15 GROUP BY angle, u, oz)"""


add("vol_project", lambda s, d: rounded(V.project(volume(s, d), [0, 45, 90], DIMS), n=4), projected([0, 45, 90]) + " SELECT angle, u, z, round(value, 4) AS value FROM pr")
add("vol_back_project", lambda s, d: rounded(V.back_project(V.ramp_filter(V.project(volume(s, d), [0, 60, 120], DIMS)), [0, 60, 120], DIMS), n=4), projected([0, 60, 120]) + """,
ker AS (SELECT m, sum(least(f, 7 - f) / 7.0::DOUBLE * cos(2 * pi() * f * m / 7)) / 7 AS h FROM range(7) a(m), range(7) b(f) GROUP BY m),
flt AS (SELECT angle, z, w, sum(value * h) AS value FROM pr, range(7) o(w), ker WHERE m = (w - u + 7) % 7 GROUP BY angle, z, w),
t AS (SELECT angle, x, y, z, (x - 3) * c + (y - 7.5::DOUBLE) * s + 3 AS at_ FROM vol, rays)
SELECT x, y, t.z, round(sum((1 - abs(at_ - w)) * value) / 3, 4) AS value FROM t JOIN flt ON flt.angle = t.angle AND flt.z = t.z AND abs(at_ - w) < 1 WHERE at_ BETWEEN 0 AND 6 GROUP BY x, y, t.z""")
add("vol_bricks", lambda s, d: V.bricked(volume(s, d), 4).groupBy("bx", "by", "bz").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")), f"WITH {VOL} SELECT x // 4 AS bx, y // 4 AS by, z // 4 AS bz, count(*) AS n, min(a) AS low, max(a) AS high FROM vol GROUP BY ALL")
