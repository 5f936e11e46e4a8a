"""sources of the ordered-stream engine."""
