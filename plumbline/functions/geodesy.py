"""Navigation: GPS time, broadcast orbit propagation, orbit errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Gravity, earth rotation, relativity and light constants of the interface spec.
MU, OMEGA_E, F_REL, LIGHT = 3.986005e14, 7.2921151467e-5, -4.442807633e-10, 299792458.0
WEEK, HALF_WEEK = 604800, 302400


def gps_week(date: Column) -> Column:
    return F.floor(F.datediff(date.cast("date"), F.lit("1980-01-06").cast("date")) / 7).cast("long")


def seconds_of_week(ts: Column) -> Column:
    day = F.pmod(F.datediff(ts.cast("date"), F.lit("1980-01-06").cast("date")), F.lit(7))
    return (day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("double")


def wrapped(dt: Column) -> Column:
    """A time difference moved into half a week either way."""
    return F.when(dt > HALF_WEEK, dt - WEEK).when(dt < -HALF_WEEK, dt + WEEK).otherwise(dt)


def propagate(df: DataFrame, t: str, toc_sow: str) -> DataFrame:
    """df with sat_x, sat_y, sat_z (metres, earth-fixed) and sat_clk (seconds) of each record at t.

    Kepler's equation takes twelve Newton steps as a fold over an array, so all of it is one
    expression per row; a record without a positive semi-axis gives null."""
    c = F.col
    a = c("sqrt_a") * c("sqrt_a")
    steps = [
        ("_a", F.when(a > 0, a)),
        ("_tk", wrapped(c(t) - c("toe"))),
        ("_m", c("m0") + (F.sqrt(F.lit(MU) / F.pow("_a", F.lit(3.0))) + c("delta_n")) * c("_tk")),
        ("_e", F.aggregate(F.array_repeat(F.lit(0), 12), c("_m"), lambda e, _: e - (e - c("e") * F.sin(e) - c("_m")) / (F.lit(1.0) - c("e") * F.cos(e)))),
        ("_phi", F.atan2(F.sqrt(F.lit(1.0) - c("e") * c("e")) * F.sin("_e"), F.cos("_e") - c("e")) + c("omega")),
        ("_u", c("_phi") + c("cus") * F.sin(c("_phi") * 2) + c("cuc") * F.cos(c("_phi") * 2)),
        ("_r", c("_a") * (F.lit(1.0) - c("e") * F.cos("_e")) + c("crs") * F.sin(c("_phi") * 2) + c("crc") * F.cos(c("_phi") * 2)),
        ("_i", c("i0") + c("idot") * c("_tk") + c("cis") * F.sin(c("_phi") * 2) + c("cic") * F.cos(c("_phi") * 2)),
        ("_o", c("omega0") + (c("omega_dot") - OMEGA_E) * c("_tk") - F.lit(OMEGA_E) * c("toe")),
        ("_xp", c("_r") * F.cos("_u")),
        ("_yp", c("_r") * F.sin("_u")),
        ("sat_x", c("_xp") * F.cos("_o") - c("_yp") * F.cos("_i") * F.sin("_o")),
        ("sat_y", c("_xp") * F.sin("_o") + c("_yp") * F.cos("_i") * F.cos("_o")),
        ("sat_z", c("_yp") * F.sin("_i")),
        ("_dt", wrapped(c(t) - c(toc_sow))),
        ("sat_clk", F.when(c("_a").isNotNull(), c("af0") + c("af1") * c("_dt") + c("af2") * c("_dt") * c("_dt") + F.lit(F_REL) * c("e") * c("sqrt_a") * F.sin("_e") - c("tgd"))),
    ]
    for name, value in steps:
        df = df.withColumn(name, value)
    return df.drop(*[n for n, _ in steps if n.startswith("_")])


def orbit_errors(df: DataFrame, ours: list[str], truth: list[str], velocity: list[str]) -> DataFrame:
    """df with radial, along and cross error of a position, in the truth's own frame."""
    p, q, v = ([F.col(x) for x in cols] for cols in (ours, truth, velocity))
    norm = lambda w: F.sqrt(w[0] * w[0] + w[1] * w[1] + w[2] * w[2])
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    d = [a - b for a, b in zip(p, q, strict=True)]
    n = cross(q, v)
    s = cross(n, q)
    return df.withColumn("radial", dot(d, q) / norm(q)).withColumn("along", dot(d, s) / norm(s)).withColumn("cross", dot(d, n) / norm(n))


def sisre(radial: Column, along: Column, cross: Column, clock_m: Column, wr: float = 0.98, wac: float = 1 / 7) -> Column:
    """Signal-in-space range error in metres."""
    ac = along * along + cross * cross
    return F.sqrt((radial * wr - clock_m) * (radial * wr - clock_m) + ac * (wac * wac))
