"""What a join is to compute, and how."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

#: The paths that can be named; paths.register() adds to them.
PATHS = ["auto", "nested_loop", "key_bucket", "time_bucket", "grid", "quantile", "replicated"]
PRELOADS = (None, "broadcast", "handshake")
#: Names under which the paths and strategies are known elsewhere.
ALIASES = {"list": "nested_loop", "bplustree": "key_bucket", "bucket": "key_bucket", "alex": "quantile", "pgm": "quantile", "broadcast": "replicated", "handshake": "key_bucket", "partitioned": "key_bucket"}


@dataclass(frozen=True)
class BandJoinSpec:
    """Pairs (r, s) with |r.ts - s.ts| <= window and |r.key - s.key| <= band, each once.

    path: the physical path; "auto" takes a bucketed one by the estimated cost. workers: parts of the replicated path, and of the
    per-worker counts. preload: rows at the start that are in the windows before the join begins, by protocol.
    key_width, ts_width: widths of buckets (default: range + 1). parts: quantiles of the quantile path's model, and its least number of buckets. salt: copies over
    which a hot bucket is spread. Any W, D >= 0 is accepted.
    """

    window: int
    band: int | float
    path: str = "auto"
    workers: int = 4
    preload: str | None = None
    key_width: int | None = None
    ts_width: int | None = None
    parts: int = 64
    salt: int = 1
    broadcast_rows: int = 1_000_000

    def __post_init__(self) -> None:
        object.__setattr__(self, "path", ALIASES.get(self.path, self.path))
        if self.path not in PATHS:
            raise ValueError(f"path must be one of {', '.join(PATHS)}, not {self.path!r}")
        if self.window < 0:
            raise ValueError("window must be 0 or more")
        if self.band < 0:
            raise ValueError("band must be 0 or more")
        if self.workers < 1:
            raise ValueError("workers must be 1 or more")
        if self.preload not in PRELOADS:
            raise ValueError(f"preload must be one of {PRELOADS}, not {self.preload!r}")
        if self.parts < 1 or self.salt < 1:
            raise ValueError("parts and salt must be 1 or more")
        for width in (self.key_width, self.ts_width):
            if width is not None and width < 1:
                raise ValueError("a bucket's width must be 1 or more")
        if not isinstance(self.band, int) and self.path in ("quantile", "grid"):
            raise ValueError("that path needs an integer band")

    def but(self, **changes: Any) -> BandJoinSpec:
        return replace(self, **changes)
