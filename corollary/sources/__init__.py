"""CSV, JSON and typed projects."""
