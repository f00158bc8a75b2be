"""Column-level helpers: pure expressions, no shuffles."""
