"""functions of the ordered-stream engine."""
