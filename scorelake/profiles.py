"""Rule sets of the three kinds of corpus."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Profile:
    name: str
    inst_by_program: bool
    default_to_unknown: bool
    velocity_skips_keyswitch: bool
    drop_tracks: str | None
    chunked: bool
    steps_per_second: int = 10
    longest_space: int = 2
    min_chunk_seconds: int = 8
    window_bars: tuple[int, ...] = (4, 8)
    keyswitch_velocity: int = 1


WEB = Profile("web", True, True, False, "program", True)
CATALOG = Profile("catalog", False, False, True, None, False)
TAGGED = Profile("tagged", True, False, False, "name", True)
PROFILES = {p.name: p for p in (WEB, CATALOG, TAGGED)}
