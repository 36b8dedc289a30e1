"""A Spark engine for preparing, auditing and judging labelled event tables."""
