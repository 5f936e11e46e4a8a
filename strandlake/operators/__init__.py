"""operators of the ordered-stream engine."""
