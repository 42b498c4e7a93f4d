"""Importing this module registers every query."""

from checks import q_chords, q_examples, q_meta, q_plans, q_scalars, q_segments, q_tokens  # noqa: F401
