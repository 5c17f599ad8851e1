"""Queries of the further filters on the bound tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import filters as X
from .bindings import VOL, read, volume
from .volume import NEIGHBOURS, WINDOWS, rounded

Q, S = {}, {}


def add(name, query, sql):
    Q[name], S[name] = query, sql


add("vol_total_variation", lambda s, d: rounded(X.total_variation(volume(s, d), 1.0, 0.3, 1)), f"""WITH {VOL}, n AS (SELECT x, y, z, a, {NEIGHBOURS} FROM vol {WINDOWS})
SELECT x, y, z, round(a + 0.3 / (1 + sqrt(((xp - xm) * (xp - xm) + (yp - ym) * (yp - ym) + (zp - zm) * (zp - zm)) / 4)) * ((xm + xp + ym + yp + zm + zp) / 6 - a), 6) AS value FROM n""")
add("vol_critical_points", lambda s, d: X.critical_points(volume(s, d)), f"""WITH {VOL}, n AS (SELECT x, y, z, a, {NEIGHBOURS} FROM vol {WINDOWS}),
k AS (SELECT x, y, z, a AS value, CASE WHEN greatest(xm, xp, ym, yp, zm, zp) <= a AND least(xm, xp, ym, yp, zm, zp) < a THEN 'max' WHEN least(xm, xp, ym, yp, zm, zp) >= a AND greatest(xm, xp, ym, yp, zm, zp) > a THEN 'min'
  WHEN ((xm > a AND xp > a) OR (ym > a AND yp > a) OR (zm > a AND zp > a)) AND ((xm < a AND xp < a) OR (ym < a AND yp < a) OR (zm < a AND zp < a)) THEN 'saddle' END AS kind FROM n) SELECT * FROM k WHERE kind IS NOT NULL""")
add("vol_seeds", lambda s, d: X.seeds_above(volume(s, d), 25), f"WITH {VOL} SELECT v.x, v.y, v.z, v.a AS value FROM vol v JOIN vol w ON abs(v.x - w.x) <= 1 AND abs(v.y - w.y) <= 1 AND abs(v.z - w.z) <= 1 GROUP BY ALL HAVING max(w.a) <= v.a ORDER BY value DESC, v.x, v.y, v.z LIMIT 25")


def image(s, d):
    """All vectors as the rows of one image."""
    return read(s, d, "embeddings").select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "v")).select("y", F.col("x").cast("long").alias("x"), F.lit(0).alias("c"), F.abs("v").cast("double").alias("v"))


def height(s, d):
    return (read(s, d, "embeddings").agg(F.max("vec_id")).first()[0] or 0) + 1


def resized(s, d):
    n = height(s, d)
    return X.resized_nearest(image(s, d), (n, 64), (n // 3, 33))


def heights(s, d):
    v = F.col("vec_id")
    points_ = read(s, d, "embeddings").select(v.alias("id"), (v + v % 7 / F.lit(7.0) - 0.2).alias("pr"), (v % 59 * 1.3 - 2).alias("pc"))
    return X.height_at(image(s, d).select(F.col("y").alias("r"), F.col("x").alias("c"), F.col("v").alias("h")), points_, height(s, d), 64)


IMG = "img AS (SELECT vec_id AS y, unnest(range(64)) AS x, abs(unnest(embedding))::DOUBLE AS v FROM embeddings), n AS (SELECT max(vec_id) + 1 AS n FROM embeddings)"
add("image_resized", resized, f"""WITH {IMG}, w AS (SELECT i AS y, j AS x, floor((i + 0.5::DOUBLE) * n / (n // 3))::BIGINT AS oy, floor((j + 0.5::DOUBLE) * 64 / 33)::BIGINT AS ox FROM (SELECT n, unnest(range(n // 3)) AS i FROM n), range(33) b(j))
SELECT w.y, w.x, 0 AS c, v FROM w JOIN img ON img.y = oy AND img.x = ox""")
add("image_converted", lambda s, d: X.converted(image(s, d), "f32", "u8"), f"WITH {IMG} SELECT y, x, 0 AS c, round(greatest(0.0, least(255.0, v * 255))) AS v FROM img")
add("height_samples", lambda s, d: rounded(heights(s, d), "h", "slope_r", "slope_c"), f"""WITH {IMG}, p AS (SELECT vec_id AS id, n, greatest(0.0::DOUBLE, least(n - 1.0::DOUBLE, vec_id + vec_id % 7 / 7.0::DOUBLE - 0.2::DOUBLE)) AS fr, greatest(0.0::DOUBLE, least(63.0, (vec_id % 59) * 1.3::DOUBLE - 2)) AS fc FROM embeddings, n),
b AS (SELECT *, least(floor(fr), n - 2)::BIGINT AS br, least(floor(fc), 62)::BIGINT AS bc FROM p), t AS (SELECT id, i, j, CASE i WHEN 1 THEN fr - br ELSE 1 - fr + br END AS wr, CASE j WHEN 1 THEN fc - bc ELSE 1 - fc + bc END AS wc, br + i AS r, bc + j AS c FROM b, range(2) x(i), range(2) y(j))
SELECT id, round(sum(wr * wc * v), 6) AS h, round(sum((2 * i - 1) * wc * v), 6) AS slope_r, round(sum(wr * (2 * j - 1) * v), 6) AS slope_c FROM t JOIN img ON img.y = r AND img.x = c GROUP BY id""")
Q["vol_contrast"] = lambda s, d: rounded(X.contrast(volume(s, d).withColumn("vol_id", F.lit("v")), 0.95))
Q["vol_vector_diffusion"] = lambda s, d: rounded(X.vector_diffusion(volume(s, d).select("x", "y", "z", (F.col("value") / 100).alias("vx"), F.sin("x").alias("vy"), F.cos("z").alias("vz")), 2), "vx", "vy", "vz")
add("vol_fft", lambda s, d: X.fft2(volume(s, d)).select("x", "y", "z", *((F.round(k, 5) + F.lit(0.0)).alias(k) for k in ("re", "im"))), f"""WITH {VOL}, t AS (SELECT u.x, u.y, v.z, v.a, -2 * pi() * (u.x * v.x / 7.0::DOUBLE + u.y * v.y / 16.0::DOUBLE) AS w
  FROM vol v, (SELECT i % 7 AS x, i // 7 AS y FROM range(112) r(i)) u) SELECT x, y, z, round(sum(a * cos(w)), 5) + 0.0 AS re, round(sum(a * sin(w)), 5) + 0.0 AS im FROM t GROUP BY x, y, z""")
Q["scatter"] = lambda s, d: X.scatter(s, 500, (0, 0, 10, 20), 7)
Q["grid_sense"] = lambda s, d: X.sense(s.range(40).select((F.col("id") % 4).alias("plane"), F.col("id").alias("step"), (F.col("id") % 16 + 5).alias("r"), (F.col("id") * 3 % 16 + 5).alias("c")), np.add.outer(np.arange(26), np.arange(26)) % 7 == 0, 6)
