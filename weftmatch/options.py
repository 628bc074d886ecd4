"""Options from text, such as environment variables: tolerant parsers with defaults. Plain Python, driver side."""

from __future__ import annotations

from collections.abc import Mapping

TRUE, FALSE = frozenset(("1", "true", "yes", "on", "y")), frozenset(("0", "false", "no", "off", "n"))


def flag(text: str | None, default: bool) -> bool:
    """A yes/no word; anything else gives the default."""
    word = (text or "").strip().lower()
    return True if word in TRUE else False if word in FALSE else default


def number(text: str | None, default: float, low: float | None = None, high: float | None = None) -> float:
    """A number within bounds; text that is no number gives the default."""
    try:
        value = float((text or "").strip())
    except ValueError:
        value = default
    value = value if low is None else max(low, value)
    return value if high is None else min(high, value)


def share(text: str | None, default: float) -> float:
    """A share from 0 to 1; above 1 it is read as percent."""
    value = number(text, default)
    return min(1.0, max(0.0, value / 100 if value > 1 else value))


def words(text: str | None) -> list[str]:
    """Comma-separated non-blank words in order, each once."""
    return list(dict.fromkeys(w.strip() for w in (text or "").split(",") if w.strip()))


def ids(text: str | None) -> set[int]:
    """Comma-separated whole numbers; others are skipped."""
    return {int(w) for w in words(text) if w.lstrip("-").isdigit()}


def usernames(text: str | None) -> set[str]:
    """Comma-separated account names in lower case with one @ in front."""
    return {"@" + w.lower().lstrip("@") for w in words(text) if w.lstrip("@")}


def pairs(text: str | None) -> dict[str, str]:
    """``a:b`` pairs in order; the last colon separates, entries without one are skipped."""
    out: dict[str, str] = {}
    for w in words(text):
        a, colon, b = w.rpartition(":")
        if colon and a.strip() and b.strip():
            out[a.strip().lower()] = b.strip()
    return out


def from_mapping(env: Mapping[str, str], prefix: str = "WEFTMATCH_") -> dict[str, str]:
    """The entries of ``env`` under ``prefix``, with lower-case names without it."""
    return {k[len(prefix) :].lower(): v for k, v in env.items() if k.startswith(prefix)}
