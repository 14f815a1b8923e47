"""Settings read from text: bad values fall back to the default and never fail."""

from __future__ import annotations

from collections.abc import Mapping

#: Defaults that are data semantics.
PUNCTUATION_THRESHOLD, SUMMARY_TOKENS, CHARS_A_TOKEN = 0.01, 6000, 3.0
FRAMES_A_MINUTE, MOST_FRAMES, FRAME_CEILING, CONCURRENCY, UPLOAD_MIB = 4.0, 20, 200, 1, 8192


def number(env: Mapping[str, str], name: str, default: float, least: float | None = None, most: float | None = None) -> float:
    try:
        value = float(env.get(name, "").strip())
    except ValueError:
        return default
    if value != value:
        return default
    value = value if least is None else max(value, least)
    return value if most is None else min(value, most)


def upload_cap(env: Mapping[str, str], name: str = "UPLOAD_MAX_MIB") -> int:
    """The largest accepted upload in bytes: MiB from the setting, 1 at least."""
    return int(number(env, name, UPLOAD_MIB, least=1)) << 20


def concurrency(env: Mapping[str, str], name: str = "JOB_CONCURRENCY") -> int:
    """Jobs at a time, 1 at least: the weight of the scheduler pool that they share."""
    return int(number(env, name, CONCURRENCY, least=1))


def summary_budget(env: Mapping[str, str], name: str = "SUMMARY_MAX_TOKENS") -> int:
    """Characters a request: the token budget by three characters each."""
    return int(number(env, name, SUMMARY_TOKENS, least=1) * CHARS_A_TOKEN)
