"""streaming of the ordered-stream engine."""
