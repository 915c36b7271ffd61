"""Settings of a graph build."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

# The defaults users know.
DEFAULT_K = 10
DEFAULT_METHOD = "lsh"
DEFAULT_RADIUS = 0.1
METHODS = ("lsh", "brute")


@dataclass(frozen=True)
class KnnConfig:
    """How to build a graph. A value of -1 means "choose from the data"."""

    k: int = DEFAULT_K
    method: str = DEFAULT_METHOD
    radius: float = DEFAULT_RADIUS
    tables: int = -1
    key_length: int = -1
    max_comparisons: int = -1
    factor: float = 1.0
    seed: int = 0
    # Stop hashing after so many rounds; None: when few points or one bucket are left.
    max_rounds: int | None = None
    share_tables: bool = False
    # Retire a point only when its lists are full too, not by its comparisons alone.
    fill_lists: bool = False
    # Buckets this large are re-hashed at a smaller radius before any distance is computed.
    split_above: int | None = None
    split_step: float = 2.5
    # Build the graph over distinct vectors and expand it. For squared distances; counters then count those.
    collapse_copies: bool = False

    def __post_init__(self):
        if self.k < 1:
            raise ValueError(f"k must be at least 1, got {self.k}")
        if self.method not in METHODS:
            raise ValueError(f"method must be one of {METHODS}, got {self.method!r}")
        if not self.radius > 0:
            raise ValueError(f"radius must be positive, got {self.radius}")
        if not self.factor > 0:
            raise ValueError(f"factor must be positive, got {self.factor}")
        if self.split_above is not None and self.split_above < 2:
            raise ValueError("split_above must be at least 2")

    @classmethod
    def from_options(cls, options: Mapping[str, object], **overrides) -> KnnConfig:
        """Read an options map; names left out keep their defaults."""
        names = {
            "num_neighbors": ("k", int),
            "method": ("method", str),
            "radius_start": ("radius", float),
            "num_tables": ("tables", int),
            "key_length": ("key_length", int),
            "max_comparisons": ("max_comparisons", int),
            "factor": ("factor", float),
        }
        unknown = set(options) - set(names)
        if unknown:
            raise ValueError(f"unknown options: {sorted(unknown)}")
        found = {field: kind(options[name]) for name, (field, kind) in names.items() if name in options}
        return replace(cls(**found), **overrides)
