"""Matching damaged CSV headers to known columns. Runs on the driver, over column names only."""

from __future__ import annotations

import re
from collections.abc import Iterable


def normal(name: str) -> str:
    """Lower-case letters and digits of any script."""
    return "".join(c for c in name.lower() if c.isalnum())


def pick(columns: Iterable[str], tokens: Iterable[str], prefer: Iterable[str] = (), exact: bool = False) -> str | None:
    """First column whose normal form contains all tokens; among several, the first that contains all preferred tokens as well.

    With ``exact`` the normal form must be the tokens joined, nothing more.
    """
    wanted, liked = [normal(t) for t in tokens], [normal(p) for p in prefer]
    fits = (lambda name: name == "".join(wanted)) if exact else (lambda name: all(t in name for t in wanted))
    found = [c for c in columns if fits(normal(c))]
    return next((c for c in found if all(p in normal(c) for p in liked)), next(iter(found), None))


def pick_pm1(columns: Iterable[str]) -> str | None:
    """A PM1 column that is not PM10 or PM100: no further digit follows."""
    found = [c for c in columns if re.search(r"pm1(?![0-9])", normal(c))]
    liked = [c for c in found if "corr" in c.lower()]
    return next(iter(liked or found), None)


#: Target column -> (tokens, preferred tokens).
SENSOR_COLUMNS = {
    "timestamp": (["timestamp"], []),
    "pm25": (["pm25"], ["corr"]),
    "pm10": (["pm10"], ["corr"]),
    "co2": (["co2"], ["corr"]),
    "tvoc": (["tvoc"], []),
    "temperature_c": (["temp"], ["corr"]),
    "humidity_pct": (["humid"], ["corr"]),
}


#: Headers that are taken first, in this order, where a file has them.
CANDIDATES = {
    "co2": ["CO2 (ppm) corrected", "CO2 (ppm) raw", "CO2 (ppm)"],
    "tvoc": ["TVOC (ppb)", "TVOC", "TVOC (ppb) corrected"],
}


def sensor_columns(columns: list[str]) -> dict[str, str]:
    """Target column -> header, for the headers that are there."""
    named = lambda target: next((c for c in CANDIDATES.get(target, []) if c in columns), None)
    found = {target: named(target) or pick(columns, tokens, prefer) for target, (tokens, prefer) in SENSOR_COLUMNS.items()}
    found["pm1"] = pick_pm1(columns)
    return {t: c for t, c in found.items() if c is not None}
