"""Arguments of queries, as callers give them. What is absent (None or an empty text) takes the default; what is
wrong raises ValueError."""

from __future__ import annotations

from collections.abc import Collection, Mapping


def absent(raw: object) -> bool:
    return raw is None or raw == ""


def choice(name: str, raw: object, allowed: Collection[str], default: str | None = None) -> str | None:
    if absent(raw):
        return default
    if raw not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {raw!r}")
    return str(raw)


def whole(name: str, raw: object, default: int | None = None, least: int = 1, most: int | None = None) -> int | None:
    """A whole number; more than the most is cut to it, less than the least is refused."""
    if absent(raw):
        return default
    if isinstance(raw, bool) or not (isinstance(raw, int) or isinstance(raw, str) and raw.isascii() and raw.lstrip("-").isdigit()):
        raise ValueError(f"{name} must be a whole number, not {raw!r}")
    n = int(raw)
    if n < least:
        raise ValueError(f"{name} must be at least {least}, not {n}")
    return n if most is None else min(n, most)


def flag(name: str, raw: object, default: bool = False) -> bool:
    if absent(raw):
        return default
    if raw in (True, "true"):
        return True
    if raw in (False, "false"):
        return False
    raise ValueError(f"{name} must be true or false, not {raw!r}")


def known_only(given: Mapping[str, object], allowed: Collection[str]) -> None:
    if unknown := sorted(set(given) - set(allowed)):
        raise ValueError(f"unknown: {', '.join(unknown)}; known are {', '.join(sorted(allowed))}")
