"""Settings that the operators take explicitly; nothing is global or changed at run time."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Camera:
    """A pinhole camera in pixels with two radial distortion terms. The default sensor."""

    focal: float = 512 / math.tan(math.radians(10.0))
    cx: float = 512.0
    cy: float = 512.0
    width: int = 1024
    height: int = 1024
    k1: float = -1e-7
    k2: float = 1e-13

    @property
    def fov(self) -> float:
        """Horizontal field of view in degrees."""
        return 2 * math.degrees(math.atan(self.width / 2 / self.focal))


@dataclass(frozen=True)
class Matching:
    """Pair matching. Tolerance and pair range in degrees, stars used of a frame, least stars and matches."""

    tolerance: float = 0.01
    least_angle: float = 0.1
    most_angle: float = 20.0
    top: int = 15
    least_stars: int = 4
    least_matches: int = 3


@dataclass(frozen=True)
class Detection:
    """Star detection. Threshold in sigma, area in pixels, eccentricity, tile size, saturation level."""

    sigma: float = 5.0
    least_area: int = 5
    most_area: int = 225
    eccentricity: float = 0.6
    box: int = 5
    saturation: float = 65535.0


@dataclass(frozen=True)
class Photometry:
    """Rendering. Width of the point spread, noise terms, exposure, gain, flux of magnitude 0, sky level."""

    psf: float = 1.2
    read_noise: float = 1.0
    dark: float = 0.1
    exposure: float = 0.5
    gain: float = 2.0
    flux0: float = 5e5
    sky: float = 10.0
    most: float = 65535.0
