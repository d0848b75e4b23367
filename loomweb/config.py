"""Settings from TOML files: trust tiers, block list, scorer weights and page families, over the fixed values as defaults."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

from .functions import values as V


def weights_of(given: dict[str, float]) -> dict[str, float]:
    """All scorer weights and rrf_k, given ones over the defaults; rrf_k is 1 at least, others 0. Unknown names are an error."""
    known = V.WEIGHTS | {"rrf_k": V.RRF_K}
    if unknown := set(given) - set(known):
        raise ValueError(f"no such weights: {', '.join(sorted(unknown))}")
    return {name: max(float(given.get(name, default)), 1.0 if name == "rrf_k" else 0.0) for name, default in known.items()}


@dataclass(frozen=True)
class Settings:
    """What the scorers and the family lookup take as arguments."""

    high: list[str] = field(default_factory=lambda: list(V.HIGH_TRUST))
    medium: list[str] = field(default_factory=lambda: list(V.MEDIUM_TRUST))
    low: list[str] = field(default_factory=list)
    blocked: list[str] = field(default_factory=lambda: list(V.BLOCKED))
    weights: dict[str, float] = field(default_factory=lambda: weights_of({}))

    @property
    def lists(self) -> dict[str, list[str]]:
        """As ranking.score() takes them."""
        return {"high": self.high, "medium": self.medium, "low": self.low, "blocked": self.blocked}


def search_paths(name: str = "loomweb.toml") -> list[Path]:
    """The project's file, then the user's."""
    home = os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config"
    return [Path("config") / name, Path(home) / "loomweb" / name]


def load(paths: Iterable[Path] | None = None) -> Settings:
    """The settings of the first file that is there, [search.trust], [search.blocklist] and [search.scoring]; defaults for what it leaves out."""
    for path in search_paths() if paths is None else paths:
        if Path(path).is_file():
            search = tomllib.loads(Path(path).read_text()).get("search", {})
            trust, blocked = search.get("trust", {}), search.get("blocklist", {}).get("domains")
            lists = {name: [str(x).lower() for x in trust[name]] for name in ("high", "medium", "low") if name in trust}
            if blocked is not None:
                lists["blocked"] = [str(x).lower() for x in blocked]
            return Settings(**lists, weights=weights_of(search.get("scoring", {})))
    return Settings()
