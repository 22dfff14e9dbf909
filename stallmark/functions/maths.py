"""Scoring arithmetic as columns. Every rounding is floor(x * k + 0.5) / k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The points of the scoring curves, the panel scores and the component weights.
RAM = [(2, 10), (4, 35), (6, 60), (8, 80), (12, 95), (16, 100)]
STORAGE = [(32, 10), (64, 35), (128, 65), (256, 85), (512, 97), (1024, 100)]
BATTERY = [(3000, 15), (4000, 35), (5000, 65), (6000, 88), (7000, 100)]
CHARGING = [(10, 15), (18, 35), (33, 60), (45, 75), (67, 90), (100, 100)]
REFRESH = [(60, 35), (90, 65), (120, 90), (144, 97), (165, 100)]
CAMERA = [(8, 15), (13, 30), (32, 55), (50, 72), (64, 78), (108, 88), (200, 95)]
UPDATES = [(0, 0), (2, 15), (4, 27), (6, 30)]
PANELS = {"AMOLED": 100, "pOLED": 100, "PLS LCD": 55, "IPS LCD": 55, "TFT LCD": 40}


def jround(c: Column, digits: int = 0) -> Column:
    k = 10.0**digits
    return F.floor(c * k + 0.5).cast("double") / k


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """Null stays null: least and greatest alone would skip it."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def curve(c: Column, points: list[tuple[float, float]]) -> Column:
    """Piecewise linear through ``points``, level outside them."""
    x = c.cast("double")
    out = F.when(x <= points[0][0], F.lit(float(points[0][1])))
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when(x <= x1, y0 + (x - x0) / (x1 - x0) * (y1 - y0))
    return F.when(x.isNotNull(), out.otherwise(F.lit(float(points[-1][1]))))


def weighted(parts: list[tuple[Column, float]]) -> Column:
    """The mean of what is known, by weight; null if nothing is."""
    known = reduce(lambda a, b: a + b, (F.when(v.isNotNull(), w).otherwise(0.0) for v, w in parts))
    total = reduce(lambda a, b: a + b, (F.coalesce(v, F.lit(0.0)) * w for v, w in parts))
    return F.when(known > 0, total / known)


def performance(antutu: Column) -> Column:
    low, high = F.log(F.lit(150000.0)), F.log(F.lit(2200000.0))
    return clamp((F.log(antutu.cast("double")) - low) / (high - low) * 100)


def memory(ram: Column, storage: Column) -> Column:
    return weighted([(curve(ram, RAM), 0.5), (curve(storage, STORAGE), 0.5)])


def display(panel: Column, refresh: Column, resolution: Column) -> Column:
    panels = reduce(lambda acc, kv: acc.when(panel == kv[0], float(kv[1])), list(PANELS.items())[1:], F.when(panel == "AMOLED", 100.0)).otherwise(50.0)
    sharp = F.when(resolution == "QHD+", 100.0).when(resolution == "FHD+", 80.0).otherwise(45.0)
    return weighted([(F.when(panel.isNotNull(), panels), 0.4), (curve(refresh, REFRESH), 0.35), (F.when(resolution.isNotNull(), sharp), 0.25)])


def battery(mah: Column, watts: Column) -> Column:
    return weighted([(curve(mah, BATTERY), 0.7), (curve(watts, CHARGING), 0.3)])


def camera(mp: Column, ois: Column, tele: Column, wide: Column, aperture: Column) -> Column:
    base = F.coalesce(curve(mp, CAMERA), F.lit(50.0))
    base = F.when(F.coalesce(ois, F.lit(False)), F.least(F.lit(100.0), base + 12)).otherwise(base)
    extra = F.when(tele.isNotNull(), 10.0).otherwise(0.0) + F.when(wide.isNotNull(), 6.0).otherwise(0.0) + F.when(aperture <= 1.7, 6.0).when(aperture <= 2.0, 3.0).otherwise(0.0)
    return F.when(mp.isNotNull() | ois.isNotNull(), F.least(F.lit(100.0), jround(base + extra)))


def extras(has5g: Column, nfc: Column, ip: Column, updates: Column) -> Column:
    known = F.when(has5g.isNotNull(), 35.0).otherwise(0.0) + F.when(nfc.isNotNull(), 15.0).otherwise(0.0) + F.when(ip.isNotNull(), 20.0).otherwise(0.0) + F.when(updates.isNotNull(), 30.0).otherwise(0.0)
    got = F.when(has5g, 35.0).otherwise(0.0) + F.when(nfc, 15.0).otherwise(0.0) + F.when(ip.isNotNull(), 20.0).otherwise(0.0) + F.coalesce(curve(updates, UPDATES), F.lit(0.0))
    return F.when(known > 0, got / known * 100)


def trust(rating: Column, count: Column, prior: Column) -> Column:
    """A rating shrunk to the prior by 500 votes, pulled to 45 where evidence is thin."""
    v = F.coalesce(count.cast("double"), F.lit(0.0))
    blended = v / (v + 500) * rating + 500 / (v + 500) * prior
    base = clamp((blended - 3) / 1.7 * 100)
    evidence = clamp(0.35 + F.log10(v + 1) / 5.5, 0.35, 1.0)
    return F.when(rating.isNotNull(), clamp(45 + (base - 45) * evidence))


def corroboration(count: Column, known: Column) -> Column:
    """How far others vouch for the specifications: ratings, else the knowledge base's confidence."""
    return F.when(F.coalesce(count, F.lit(0)) >= 5, 1.0).when(known == "high", 0.95).when(known == "medium", 0.85).when(known == "low", 0.75).otherwise(0.6)


def deal(discount: Column, mrp: Column, price: Column, spread: Column, offers: Column, median: Column, history: dict[str, Column] | None = None) -> Column:
    """50, more for a credible discount, for more offers and below the median; less for a discount over 55 %.

    ``history`` (low, runs, position, trend) of the product's recorded prices counts from its second run on.
    """
    credible = F.when(discount <= 40, discount.cast("double")).otherwise(F.greatest(F.lit(0.0), 40 - 2.0 * (discount - 40)))
    cut = F.when(discount.isNotNull() & mrp.isNotNull(), F.when(discount > 55, -6.0).otherwise(0.6 * credible)).otherwise(0.0)
    more = F.when(offers > 1, F.when(spread > 0, F.least(F.lit(15.0), spread / price * 100)).otherwise(0.0) + 5.0).otherwise(0.0)
    told = F.lit(0.0)
    if history:
        where = F.when(price <= history["low"], 20.0).when(history["position"] <= 0.15, 12.0).when(history["position"] >= 0.85, -12.0).otherwise(0.0)
        way = F.when(history["trend"] == "falling", -4.0).when(history["trend"] == "rising", 4.0).otherwise(0.0)
        told = F.when(history["runs"] >= 2, where + way).otherwise(0.0)
    return clamp(50.0 + cut + more + F.when(price < median, 5.0).otherwise(0.0) + told)
