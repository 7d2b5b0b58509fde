"""Reflectance to single-scattering albedo and back (Hapke's isotropic approximation)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import clip, col

CEILING = 1.0 - 1e-9


def albedo_of_reflectance(r: Column) -> Column:
    r = clip(r, 0.0, CEILING)
    s = (1.0 - r) / (1.0 + r)
    return 1.0 - s * s


def reflectance_of_albedo(w: Column) -> Column:
    w = clip(w, 0.0, CEILING)
    root = 1.0 + F.sqrt(1.0 - w)
    return w / (root * root)


def to_albedo(spectrum) -> Column:
    return F.transform(col(spectrum), albedo_of_reflectance)


def to_reflectance(albedo) -> Column:
    return F.transform(col(albedo), reflectance_of_albedo)
