"""strandlake: ordered streams of fixed-width unsigned keys, and document operators, on Spark."""
