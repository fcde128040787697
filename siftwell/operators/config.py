"""Parameters of the scoring engine."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Weights and thresholds, folded into plans as literals. The defaults are fixed values of the scoring contract."""

    base_spam: float = -2.2
    base_slop: float = -1.4
    link_ratio_above: float = 0.15
    link_ratio_weight: float = 2.5
    uppercase_above: float = 0.6
    uppercase_weight: float = 1.2
    diversity_below: float = 0.35
    diversity_weight: float = 1.0
    reputation_above: float = 0.5
    ip_weight: float = 3.0
    disposable_weight: float = 1.5
    domain_weight: float = 3.0
    fingerprint_weight: float = 3.5
    classifier_spam_weight: float = 1.0
    classifier_slop_weight: float = 0.7
    slop_reason_above: float = 0.6


DEFAULT = Config()


@dataclass(frozen=True)
class Mode:
    """How the engine runs: local stores alone, or hosted for tenants with a network store, its secret and their keys."""

    hosted: bool
    stores: str
    network: str | None = None
    secret: str | None = None
    keys: str | None = None
    per_minute: int = 600


def mode_of(settings: Mapping[str, str]) -> Mode:
    """The mode of settings (mode, stores, network, secret, keys, rate_limit_per_minute), as from an environment.

    mode is "local", "self-hosted" (the same) or "hosted"; hosted needs secret and keys. Raises on another mode, a missing
    value or a limit that isn't a positive integer.
    """
    mode, stores = settings.get("mode", "local"), settings.get("stores", "stores")
    if mode in ("local", "self-hosted"):
        return Mode(False, stores)
    if mode != "hosted":
        raise ValueError(f"unsupported mode {mode!r}")
    for name in ("secret", "keys"):
        if not settings.get(name):
            raise ValueError(f"the hosted mode needs {name}")
    limit = settings.get("rate_limit_per_minute", "600")
    if not limit.isascii() or not limit.isdigit() or not int(limit):
        raise ValueError("rate_limit_per_minute must be a positive integer")
    return Mode(True, stores, settings.get("network", f"{stores}-network"), settings["secret"], settings["keys"], int(limit))
