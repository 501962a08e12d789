"""Versioned transition tables of time zones as numpy arrays."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from functools import cache, lru_cache
from importlib import resources
from pathlib import Path
from zoneinfo import TZPATH, ZoneInfo

import numpy as np

FIRST_YEAR, LAST_YEAR, STEP_DAYS = 1900, 2100, 2


@cache
def version() -> str:
    """Release of the zone data in use, or 'unknown'."""
    for folder in TZPATH:
        for name in ("+VERSION", "tzdata.zi"):
            if (file := Path(folder, name)).is_file():
                with file.open(encoding="utf-8", errors="replace") as f:
                    return f.readline().replace("# version", "").strip()
    try:
        return resources.files("tzdata").joinpath("zones").parent.joinpath("zoneinfo/tzdata.zi").read_text().split("\n")[0].replace("# version", "").strip()
    except (ModuleNotFoundError, FileNotFoundError):
        return "unknown"


def _offset(zone: ZoneInfo, second: int) -> int:
    at = datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=second)
    return int(at.astimezone(zone).utcoffset().total_seconds())


@lru_cache(2048)
def transitions(name: str) -> tuple[np.ndarray, np.ndarray] | None:
    """UTC seconds of the changes of a zone's offset, and the offsets before, between and behind them; None for an unknown zone.

    Changes are found by bisection between probes ``STEP_DAYS`` apart, through the standard library's reader of the zone data.
    """
    try:
        zone = ZoneInfo(name)
    except Exception:  # noqa: BLE001 - unknown, empty or malformed key
        return None
    step = STEP_DAYS * 86_400
    begin = int(datetime(FIRST_YEAR, 1, 1, tzinfo=UTC).timestamp())
    end = int(datetime(LAST_YEAR, 1, 1, tzinfo=UTC).timestamp())
    at, offsets = [], [_offset(zone, begin)]
    for second in range(begin + step, end, step):
        if (now := _offset(zone, second)) != offsets[-1]:
            low, high = second - step, second
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if _offset(zone, middle) == offsets[-1] else (low, middle)
            at.append(high)
            offsets.append(now)
    return np.array(at, np.int64), np.array(offsets, np.int64)


def wall_to_utc(name: str, wall: np.ndarray, later: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """UTC seconds of wall clock seconds in a zone, and which wall clocks occur twice.

    A wall clock that occurs twice or never is read with the offset before the change; where ``later`` is set, one that occurs
    twice is read with the offset behind it.
    """
    table = transitions(name)
    if table is None:
        return None
    at, offsets = table
    before, behind = offsets[:-1], offsets[1:]
    i = np.searchsorted(at + np.maximum(before, behind), wall, "right")
    twice = np.zeros(len(wall), bool)
    if len(at):
        j = np.minimum(i, len(at) - 1)
        twice = (i < len(at)) & (behind[j] < before[j]) & (wall >= at[j] + behind[j])
        if later is not None:
            i = i + (twice & later)
    return wall - offsets[i], twice
