"""Defaults that change results; immutable, and passed where they are needed."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Axis:
    """Equal bins from low to high. Sample i is low + i * width, so high itself is no sample."""

    bins: int
    low: float
    high: float

    @property
    def width(self) -> float:
        return (self.high - self.low) / self.bins

    def value(self, i: int) -> float:
        return self.low + i * self.width

    def sub_axis(self, low: float, high: float) -> Axis:
        """The bins whose samples lie in [low, high)."""
        first = next((i for i in range(self.bins) if self.value(i) >= low - 1e-12), self.bins)
        last = next((i for i in range(first, self.bins) if self.value(i) >= high - 1e-12), self.bins)
        return Axis(last - first, self.value(first), self.value(last))


#: Distance axis, q axis, and the range of q that is used.
DISTANCE_AXIS = Axis(8000, 0.0, 2000.0)
Q_AXIS = Axis(200, 1e-4, 1.0)
Q_RANGE = (1e-4, 0.5)
#: Electrons per cubic Angstrom of water.
WATER_DENSITY = 0.334


@dataclass(frozen=True)
class GridConfig:
    cell: float = 1.0
    padding: float = 0.25
    exv_radius: float = 2.15
    exv_width: float = 1.0
    surface_thickness: float = 1.0


@dataclass(frozen=True)
class FitConfig:
    points: int = 100
    max_iterations: int = 100
    water_scale: tuple[float, float] = (0.0, 10.0)
    exv_scale: tuple[float, float] = (0.92, 1.08)
    density: tuple[float, float] = (0.5, 2.0)
    debye_waller: tuple[float, float] = (0.0, 5.0)
