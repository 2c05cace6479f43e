"""Settings of an analysis. Chunk and batch sizes have no meaning here: Spark sizes its own batches."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from typing import Any

#: Names that a scan leaves out.
IGNORE_GLOBS = ("*.tmp", "~*", "*.cache", "Thumbs.db", ".DS_Store")
ALGORITHMS = ("md5", "sha1", "sha256", "sha512")
#: What counts as true in the environment.
TRUE = ("true", "1", "yes")


@dataclass(frozen=True)
class EngineConfig:
    algorithm: str = "sha256"
    quick_hash_size: int = 1024
    sampled_from: int = 100 << 20
    sample_size: int = 1 << 20
    max_depth: int | None = None
    follow_symlinks: bool = False
    ignore_hidden: bool = False
    ignore_globs: tuple[str, ...] = IGNORE_GLOBS
    min_size: int = 0
    universe: str = "candidates"
    state_dir: str | None = None
    verbose: bool = False
    debug: bool = False

    def __post_init__(self) -> None:
        if self.algorithm not in ALGORITHMS:
            raise ValueError(f"unknown algorithm {self.algorithm!r}")
        if self.universe not in ("candidates", "all"):
            raise ValueError(f"unknown universe {self.universe!r}")

    @property
    def quick_from(self) -> int:
        """A quick hash pays for files larger than this."""
        return 3 * self.quick_hash_size

    @classmethod
    def from_dict(cls, values: Mapping[str, Any]) -> EngineConfig:
        """Unknown keys are left out."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if k == "ignore_globs" else v for k, v in values.items() if k in known})

    @classmethod
    def from_env(cls, prefix: str = "MIRRORFOLD_") -> EngineConfig:
        found: dict[str, Any] = {}
        for key, name in (("STATE_DIR", "state_dir"), ("HASH_ALGORITHM", "algorithm")):
            if value := os.environ.get(prefix + key):
                found[name] = value
        if value := os.environ.get(prefix + "VERBOSE"):
            found["verbose"] = value.lower() in TRUE
        return cls(**found)
