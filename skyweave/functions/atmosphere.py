"""Atmospheric correction and radiative transfer as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyweave.functions.quality import finite


def invert(toa: Column, xap: Column, xbp: Column, xcp: Column) -> Column:
    """Surface reflectance from top-of-atmosphere reflectance."""
    y = xap * toa - xbp
    return y / (F.lit(1.0) + xcp * y)


def correct(toa: Column, xap: Column, xbp: Column, xcp: Column) -> Column:
    """``invert`` with negatives at 0; what is not finite stays missing."""
    return F.when(finite(toa), F.greatest(invert(toa, xap, xbp, xcp), F.lit(0.0)))


def correct_stack(toa: Column, xap: Column, xbp: Column, xcp: Column) -> Column:
    """``correct`` over arrays by band; unequal lengths are an error."""
    checked = F.when((F.size(toa) == F.size(xap)) & (F.size(xap) == F.size(xbp)) & (F.size(xbp) == F.size(xcp)), F.arrays_zip(toa.alias("t"), xap.alias("a"), xbp.alias("b"), xcp.alias("c"))).otherwise(F.raise_error(F.lit("a coefficient for each band is needed")))
    return F.transform(checked, lambda x: correct(x["t"], x["a"], x["b"], x["c"]))


def correct_number(number: Column, xap: Column, xbp: Column, xcp: Column) -> Column:
    """The same on scaled integers: nodata passes, half away from zero, capped below nodata."""
    value = F.round(invert(number / 10000.0, xap, xbp, xcp) * 10000.0)
    return F.when(number == 65535, 65535).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(65534.0)).cast("int"))


def interpolate(nodes: Column, values: Column, at: Column) -> Column:
    """Linear interpolation over ascending nodes, clamped at both ends; null without nodes."""
    n = F.size(nodes)
    clamped = F.least(F.greatest(at, F.element_at(nodes, 1)), F.element_at(nodes, -1))
    found = F.array_position(F.transform(nodes, lambda x: x >= clamped), True).cast("int")
    upper = F.greatest(found, F.lit(2))
    x0, x1 = F.element_at(nodes, upper - 1), F.element_at(nodes, upper)
    y0, y1 = F.element_at(values, upper - 1), F.element_at(values, upper)
    return F.when(n == 1, F.element_at(values, 1)).when(n > 1, y0 + (y1 - y0) * (clamped - x0) / (x1 - x0))


def coefficients(nodes: Column, xap: Column, xbp: Column, xcp: Column, water: Column) -> Column:
    """(xap, xbp, xcp) at a water vapour; without nodes the identity (1, 0, 0)."""
    return F.struct(
        F.coalesce(interpolate(nodes, xap, water), F.lit(1.0)).alias("xap"),
        F.coalesce(interpolate(nodes, xbp, water), F.lit(0.0)).alias("xbp"),
        F.coalesce(interpolate(nodes, xcp, water), F.lit(0.0)).alias("xcp"),
    )


def aod_at(aod: Column, angstrom: Column, wavelength: float = 550.0, reference: float = 500.0) -> Column:
    """Optical depth at another wavelength."""
    return aod * F.pow(F.lit(wavelength / reference), -angstrom)


def boa_offset(number: Column, collection: Column, baseline: Column, item_id: Column, harmonised: bool = False) -> Column:
    """Remove the +1000 offset of processing baselines from 04.00 on, without going below 0.

    The baseline comes from the property, else from the ``N####`` token of the id.
    """
    token = F.regexp_extract(item_id, r"_N([0-9]{4})", 1)
    of_id = F.when(token != "", token.cast("double") / 100)
    known = F.coalesce(baseline.try_cast("double"), of_id)
    applies = (collection == "sentinel-2-l2a") & (F.coalesce(known, F.lit(0.0)) >= 4.0) & F.lit(not harmonised)
    return F.when(applies, F.greatest(number - 1000, F.lit(0))).otherwise(number)


# Fixed values of the single-scattering model: Rayleigh depth at 1 micrometre and its
# corrections, aerosol exponent, asymmetry and single-scattering albedo, and the
# weights of both depths in the spherical albedo.
RAYLEIGH = (0.008569, 0.0113, 0.00013)
ANGSTROM, ASYMMETRY, SCATTERED = 1.2, 0.65, 0.95
ALBEDO = (0.92, 0.33)
#: Sun zenith, view zenith and relative azimuth in degrees.
GEOMETRY = (28.0, 5.0, 120.0)


def optics(aod: Column, wavelength: Column, geometry: tuple[float, float, float] = GEOMETRY) -> Column:
    """(path, transmission, albedo) of the atmosphere at a wavelength in micrometres."""
    sun, view, azimuth = (math.radians(x) for x in geometry)
    air = 1 / math.cos(sun) + 1 / math.cos(view)
    angle = math.sin(sun) * math.sin(view) * math.cos(azimuth) - math.cos(sun) * math.cos(view)
    molecules = RAYLEIGH[0] * F.pow(wavelength, F.lit(-4.0)) * (1 + RAYLEIGH[1] * F.pow(wavelength, F.lit(-2.0)) + RAYLEIGH[2] * F.pow(wavelength, F.lit(-4.0)))
    particles = aod * F.pow(wavelength / 0.55, F.lit(-ANGSTROM))
    phase_m = 0.75 * (1 + angle**2)
    phase_p = (1 - ASYMMETRY**2) / (1 + ASYMMETRY**2 - 2 * ASYMMETRY * angle) ** 1.5
    path = (molecules * phase_m + particles * (SCATTERED * phase_p)) / (4 * math.cos(sun) * math.cos(view))
    transmission = F.exp((molecules * 0.5 + particles * (1 - SCATTERED * ASYMMETRY)) * -air)
    return F.struct(path.alias("path"), transmission.alias("transmission"), (molecules * ALBEDO[0] + particles * ALBEDO[1]).alias("albedo"))


def forward(surface: Column, path: Column, transmission: Column, albedo: Column) -> Column:
    return path + transmission * surface / (1 - albedo * surface)


def inverse(toa: Column, path: Column, transmission: Column, albedo: Column) -> Column:
    u = toa - path
    return u / (transmission + albedo * u)
