"""Parameters of the raster workflow."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Pixels with this label take no part in training or evaluation.
IGNORE = 255


@dataclass(frozen=True)
class Grid:
    """A raster of height x width pixels, numbered row by row in 64 bits."""

    height: int
    width: int


@dataclass(frozen=True)
class Windows:
    """Square windows of ``size`` pixels at every ``step``."""

    size: int = 256
    step: int = 128

    @classmethod
    def at_overlap(cls, size: int, overlap: float) -> Windows:
        return cls(size, max(1, int((1 - overlap) * size)))

    def count(self, length: int) -> int:
        """Windows along an axis; partial ones at the edge don't count."""
        if length < self.size:
            raise ValueError(f"an axis of {length} pixels is shorter than a window of {self.size}")
        return (length - self.size) // self.step + 1


@dataclass(frozen=True)
class Clipping:
    """Outlier thresholds from a histogram."""

    bins: int = 1_000_000
    lower: float = 0.001
    upper: float = 0.999


@dataclass(frozen=True)
class Split:
    """Shares of kept windows; ``mode`` "separate" has a label raster of its own for testing."""

    min_positive: float = 0.01
    test: float = 0.2
    validation: float = 0.2
    seed: int = 42
    mode: str = "single"


@dataclass(frozen=True)
class Stopping:
    min_epochs: int = 20
    patience: int = 15
    min_delta: float = 5e-5


@dataclass(frozen=True)
class Training:
    learning_rate: float = 1e-4
    gamma: float = 0.995
    max_epochs: int = 300
    class_weights: dict[int, float] = field(default_factory=lambda: {0: 0.3, 1: 0.7})
    batch_size: int = 8
    prediction_batch_size: int = 128
    prediction_overlaps: tuple[float, ...] = (0.0, 0.25, 0.5)


@dataclass(frozen=True)
class Experiment:
    """A model setting: which sources feed it and how they join."""

    name: str
    fusion: str = "optical"  # optical, early or late
    lidar_bands: tuple[int, ...] | None = None
