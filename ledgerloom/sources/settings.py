"""Settings of a run: folders and options in code, secrets and service names only by the variables that hold them."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

from ledgerloom.sources.schemas import CONFIDENCE_THRESHOLD, MERGE_THRESHOLD


@dataclass(frozen=True)
class Settings:
    """A run's inputs and options; ``source`` sets the confidence that extraction starts from."""

    candidates: str = "./graph_recon"
    metadata: str | None = None
    source: str = field(default="pdf_text", metadata={"choices": ("pdf_text", "photographed")})
    confidence: float = CONFIDENCE_THRESHOLD
    threshold: float = MERGE_THRESHOLD
    skip_vectors: bool = False

    def __post_init__(self):
        for f in fields(self):
            allowed = f.metadata.get("choices")
            if allowed and getattr(self, f.name) not in allowed:
                raise ValueError(f"{f.name} must be one of {', '.join(allowed)}")

    @classmethod
    def of(cls, env: Mapping[str, str] = os.environ, **given) -> Settings:
        """Arguments that are given win over the environment (names in upper case), that over the defaults."""
        kinds = {"confidence": float, "threshold": float, "skip_vectors": lambda v: v.strip().lower() in ("1", "true", "yes")}
        named = {f.name: kinds.get(f.name, str)(env[f.name.upper()]) for f in fields(cls) if env.get(f.name.upper())}
        return cls(**(named | {k: v for k, v in given.items() if v is not None}))


def required(names: list[str], env: Mapping[str, str] = os.environ) -> dict[str, str]:
    """The values of variables that a boundary needs. All that are absent or empty are named at once, before any work."""
    missing = [n for n in names if not env.get(n)]
    if missing:
        raise ValueError(f"missing required variables: {', '.join(missing)}")
    return {n: env[n] for n in names}
