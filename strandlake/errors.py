"""What the engine raises where an input breaks a rule of a stream."""

from __future__ import annotations


class StreamError(ValueError):
    """A stream's rule is broken: positions with gaps, a reach too far back, overlapping intervals, a null key."""
