"""Window durations: ``PT10M``, ``PT30S``, ``PT2H`` or a plain number of ticks."""

from __future__ import annotations

import re

# Seconds per duration unit.
UNIT_SECONDS = {"S": 1, "M": 60, "H": 3600}


def seconds(duration: str | int) -> int:
    if isinstance(duration, int):
        return duration
    if re.fullmatch(r"\d+", duration):
        return int(duration)
    found = re.fullmatch(r"PT(\d+)([SMH])", duration)
    if not found:
        raise ValueError(f"not a duration: {duration!r}")
    return int(found.group(1)) * UNIT_SECONDS[found.group(2)]


def interval(duration: str | int) -> str:
    """The same duration as a Spark interval string."""
    return f"{seconds(duration)} seconds"
