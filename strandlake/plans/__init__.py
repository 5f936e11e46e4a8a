"""plans of the ordered-stream engine."""
