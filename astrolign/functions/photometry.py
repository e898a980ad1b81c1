"""Magnitudes, fluxes, quality and random sky directions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def magnitude_to_flux(magnitude: Column, flux0: float, exposure: float = 1.0) -> Column:
    return flux0 * exposure * F.pow(F.lit(10.0), -0.4 * magnitude)


def instrumental_magnitude(flux: Column) -> Column:
    """Null for fluxes of zero or less."""
    return -2.5 * F.log10(F.when(flux > 0, flux))


def signal_to_noise(peak: Column, sigma: Column) -> Column:
    return peak / F.greatest(sigma, F.lit(1.0))


def quality(peak: Column, snr: Column, sigma: float, saturation: float) -> Column:
    return F.when(peak >= 0.9 * saturation, "saturated").when(snr < 2 * sigma, "marginal").otherwise("good")


def sky_direction(u1: Column, u2: Column) -> tuple[Column, Column]:
    """Right ascension and declination of two uniform numbers, even over the sphere."""
    return 360 * u1, F.degrees(F.asin(2 * u2 - 1))


def galactic_latitude_sine(ra: Column, dec: Column) -> Column:
    """The north galactic pole of J2000."""
    pole_ra, pole_dec = F.radians(F.lit(192.85948)), F.radians(F.lit(27.12825))
    return F.sin(F.radians(dec)) * F.sin(pole_dec) + F.cos(F.radians(dec)) * F.cos(pole_dec) * F.cos(F.radians(ra) - pole_ra)
