"""Namespace policies, grants and their validation."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field

_ID = re.compile(r"[A-Za-z0-9_-]{1,64}")
OPERATIONS = ("get", "put", "delete", "list", "stats")


class PolicyError(ValueError):
    """A policy that contradicts itself or is out of range."""


@dataclass(frozen=True)
class Namespace:
    name: str
    purpose: str = "records"  # or checkpoints
    mode: str = "durable"  # or memory
    require_ttl: bool = False
    default_ttl_seconds: int | None = None
    max_ttl_seconds: int | None = None
    value_kind: str = "json"  # bytes, utf8 or json
    max_key_bytes: int = 256
    max_value_bytes: int = 65_536
    max_entries: int = 10_000
    max_total_bytes: int = 64 << 20
    on_full: str = "reject"  # or evict_oldest

    def validate(self) -> None:
        checks = (
            (_ID.fullmatch(self.name), "name"),
            (self.purpose in ("records", "checkpoints"), "purpose"),
            (self.mode in ("durable", "memory"), "mode"),
            (self.value_kind in ("bytes", "utf8", "json"), "value_kind"),
            (self.on_full in ("reject", "evict_oldest"), "on_full"),
            (min(self.max_key_bytes, self.max_value_bytes, self.max_entries, self.max_total_bytes) > 0, "positive limits"),
            (self.max_key_bytes + self.max_value_bytes <= self.max_total_bytes, "a record must fit the namespace"),
            (self.mode == "memory" or self.on_full == "reject", "durable namespaces cannot evict"),
            (self.max_ttl_seconds is None or self.require_ttl, "a greatest TTL needs require_ttl"),
            (self.default_ttl_seconds is None or self.default_ttl_seconds > 0, "default TTL"),
            (None in (self.default_ttl_seconds, self.max_ttl_seconds) or self.default_ttl_seconds <= self.max_ttl_seconds, "default TTL over the greatest"),
            (self.purpose != "checkpoints" or (self.mode == "durable" and not self.require_ttl and self.default_ttl_seconds is None), "checkpoint namespaces are durable, without TTL"),
        )
        for ok, what in checks:
            if not ok:
                raise PolicyError(f"{self.name}: {what}")

    def ttl(self, asked: int | None) -> tuple[int | None, str | None]:
        """Effective TTL and an error code."""
        ttl = self.default_ttl_seconds if asked is None else asked
        if ttl is None:
            return None, "invalid" if self.require_ttl else None
        if ttl <= 0 or (self.max_ttl_seconds is not None and ttl > self.max_ttl_seconds) or ttl > (1 << 63) // 1000:
            return None, "invalid"
        return ttl, None


@dataclass(frozen=True)
class Limits:
    max_candidates: int = 1000
    max_scan_bytes: int = 4 << 20
    max_result_bytes: int = 65_536
    max_search_postings: int = 20_000
    cleanup_batch: int = 100

    def validate(self) -> None:
        ranges = (
            ("max_candidates", 1, 100_000),
            ("max_search_postings", 1, 1_000_000),
            ("max_scan_bytes", 64 << 10, 64 << 20),
            ("max_result_bytes", 1 << 10, 1 << 20),
        )
        for name, low, high in ranges:
            if not low <= getattr(self, name) <= high:
                raise PolicyError(f"{name} is not within {low}..{high}")


@dataclass(frozen=True)
class Policy:
    namespaces: tuple[Namespace, ...]
    limits: Limits = field(default_factory=Limits)
    grants: tuple[tuple[str, str, str], ...] = ()  # principal, namespace, operation

    def validate(self) -> Policy:
        names = [n.name for n in self.namespaces]
        if len(set(names)) != len(names):
            raise PolicyError("namespace names repeat")
        for n in self.namespaces:
            n.validate()
        self.limits.validate()
        if len(set(self.grants)) != len(self.grants):
            raise PolicyError("grants repeat")
        for _, namespace, operation in self.grants:
            if namespace not in names or operation not in OPERATIONS:
                raise PolicyError("a grant names an unknown namespace or operation")
        return self

    def namespace(self, name: str) -> Namespace | None:
        return next((n for n in self.namespaces if n.name == name), None)


def parse_policy(text: str) -> Policy:
    """A policy from TOML: [[namespaces]], [limits] and [[grants]]; unknown fields are refused."""
    raw = tomllib.loads(text)
    if extra := set(raw) - {"namespaces", "limits", "grants"}:
        raise PolicyError(f"unknown sections: {sorted(extra)}")
    try:
        namespaces = tuple(Namespace(**n) for n in raw.get("namespaces", []))
        limits = Limits(**raw.get("limits", {}))
    except TypeError as error:
        raise PolicyError(str(error)) from None
    grants = tuple((g["principal"], g["namespace"], op) for g in raw.get("grants", []) for op in g["operations"])
    return Policy(namespaces, limits, grants).validate()
