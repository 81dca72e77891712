"""Parameter objects of the operators, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Search:
    """Which neighbours an estimate uses."""

    radius: float = 1000.0
    min_points: int = 1
    max_points: int = 12
    sectors: int = 0
    max_per_sector: int = 4
    anisotropy_ratio: float = 1.0
    anisotropy_angle: float = 0.0


@dataclass(frozen=True)
class Variogram:
    """A fitted model; sill is the partial sill."""

    kind: str = "spherical"
    nugget: float = 0.0
    sill: float = 1.0
    range: float = 1000.0

    @property
    def total_sill(self) -> float:
        return self.nugget + self.sill


@dataclass(frozen=True)
class Kriging:
    kind: str = "ordinary"
    mean: float | None = None
    regularization: float = 1e-10
    condition_limit: float = 1e12


@dataclass(frozen=True)
class Rbf:
    kernel: str = "multiquadric"
    epsilon: float = 1.0
    regularization: float = 1e-12
    degree: int = -1


@dataclass(frozen=True)
class Grid:
    bounds: tuple[float, float, float, float] | None = None
    cell_size: float | None = None
    nx: int | None = None
    ny: int | None = None
    buffer: float = 0.0
