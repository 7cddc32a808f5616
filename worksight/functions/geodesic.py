"""Distance on the WGS-84 ellipsoid as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from worksight.functions.scalar import col

# The ellipsoid's greater half axis in metres, and its flattening.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
MINOR = AXIS * (1 - FLATTENING)
ROUNDS, CLOSE = 60, 1e-12


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _on_sphere(p: Column, lam: Column, use) -> Column:
    """use(s) with the arc between two points of the auxiliary sphere for a difference of longitude lam."""
    sin_arc = F.hypot(p["c2"] * F.sin(lam), p["c1"] * p["s2"] - p["s1"] * p["c2"] * F.cos(lam))
    cos_arc = p["s1"] * p["s2"] + p["c1"] * p["c2"] * F.cos(lam)

    def azimuth(a: Column) -> Column:
        sin_az = F.when(a["sin"] == 0, F.lit(0.0)).otherwise(p["c1"] * p["c2"] * F.sin(lam) / a["sin"])
        return let(sin_az, lambda az: let(1 - az * az, lambda q: middle(a, az, q)))

    def middle(a: Column, az: Column, q: Column) -> Column:
        cos_mid = F.when(q <= 0, F.lit(0.0)).otherwise(a["cos"] - 2 * p["s1"] * p["s2"] / q)
        return let(F.struct(a["sin"].alias("sin"), a["cos"].alias("cos"), F.atan2(a["sin"], a["cos"]).alias("arc"), az.alias("az"), q.alias("q"), cos_mid.alias("mid")), use)

    return let(F.struct(sin_arc.alias("sin"), cos_arc.alias("cos")), azimuth)


def _next(p: Column, lam: Column) -> Column:
    """The difference of longitude on the sphere that follows from an estimate of it."""

    def told(s: Column) -> Column:
        c = FLATTENING / 16 * s["q"] * (4 + FLATTENING * (4 - 3 * s["q"]))
        return let(c, lambda c: p["dl"] + (1 - c) * FLATTENING * s["az"] * (s["arc"] + c * s["sin"] * (s["mid"] + c * s["cos"] * (2 * s["mid"] * s["mid"] - 1))))

    return _on_sphere(p, lam, told)


def _metres(p: Column, lam: Column) -> Column:
    def told(s: Column) -> Column:
        u = s["q"] * (AXIS**2 - MINOR**2) / MINOR**2
        a = lambda u: 1 + u / 16384 * (4096 + u * (u * (320 - 175 * u) - 768))
        b = lambda u: u / 1024 * (256 + u * (u * (74 - 47 * u) - 128))
        mid2 = s["mid"] * s["mid"]
        turn = lambda b: b * s["sin"] * (s["mid"] + b / 4 * (s["cos"] * (2 * mid2 - 1) - b / 6 * s["mid"] * (4 * s["sin"] * s["sin"] - 3) * (4 * mid2 - 3)))
        return let(u, lambda u: let(b(u), lambda b: MINOR * a(u) * (s["arc"] - turn(b))))

    return _on_sphere(p, lam, told)


def geodesic(lat1, lon1, lat2, lon2) -> Column:
    """struct(metres, converged) between two points in degrees.

    The longitude on the auxiliary sphere is iterated to a fixed point; few rounds suffice
    but for points that are nearly opposite each other, where converged is false and metres
    null. Both are null where a coordinate is null or out of range.
    """
    lat1, lon1, lat2, lon2 = (col(c).cast("double") for c in (lat1, lon1, lat2, lon2))
    ok = F.abs(lat1).between(0, 90) & F.abs(lat2).between(0, 90) & F.abs(lon1).between(0, 180) & F.abs(lon2).between(0, 180)
    reduced = lambda lat: F.atan((1 - FLATTENING) * F.tan(F.radians(lat)))
    # The shorter way round: between -180 and 180 degrees.
    turn = F.pmod(lon2 - lon1 + 180, F.lit(360.0)) - 180

    def solve(p: Column) -> Column:
        start = F.struct(p["dl"].alias("lam"), F.lit(False).alias("done"))
        step = lambda acc, _: F.when(acc["done"], acc).otherwise(let(_next(p, acc["lam"]), lambda new: F.struct(new.alias("lam"), (F.abs(new - acc["lam"]) < CLOSE).alias("done"))))
        solved = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
        return let(solved, lambda s: F.struct(F.when(s["done"], _metres(p, s["lam"])).alias("metres"), s["done"].alias("converged")))

    points = let(F.struct(reduced(lat1).alias("u1"), reduced(lat2).alias("u2"), F.radians(turn).alias("dl")), lambda u: F.struct(F.sin(u["u1"]).alias("s1"), F.cos(u["u1"]).alias("c1"), F.sin(u["u2"]).alias("s2"), F.cos(u["u2"]).alias("c2"), u["dl"].alias("dl")))
    return F.when(ok, let(points, solve))


def geodesic_km(lat1, lon1, lat2, lon2) -> Column:
    return geodesic(lat1, lon1, lat2, lon2)["metres"] / 1000
