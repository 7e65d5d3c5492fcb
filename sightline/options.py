"""Options of whole runs, with the names that command lines use for them."""

from __future__ import annotations

from dataclasses import dataclass, field

from sightline.operators.detect import Options
from sightline.operators.frames import Selection

ALGORITHMS = {"eigen": "eigenfaces", "eigenfaces": "eigenfaces", "pca": "eigenfaces", "fisher": "fisherfaces", "fisherfaces": "fisherfaces", "lda": "fisherfaces", "lbph": "lbph"}
MODES = {"identification": "identification", "id": "identification", "verification": "verification", "ver": "verification", "all": "all", "both": "all"}


def algorithms(name: str) -> list[str]:
    if name == "all":
        return ["eigenfaces", "fisherfaces", "lbph"]
    if name.lower() not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {name}")
    return [ALGORITHMS[name.lower()]]


@dataclass(frozen=True)
class Run:
    """A detection run: how to scan, which frames to write, and whether and how to track."""

    detect: Options = field(default_factory=Options)
    select: Selection = field(default_factory=Selection)
    fps: float = 1.0
    track: bool = False
    track_threshold: float = 0.3
    padding: float = 0.2
    crops: bool = False
    align: bool = False


@dataclass(frozen=True)
class Benchmark:
    algorithm: str = "all"
    mode: str = "all"
    folds: int = 5
    seed: int = 42
    pairs: int = 2000
