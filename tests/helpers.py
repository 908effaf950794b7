"""Helpers the test modules import by name (no test imports a conftest)."""

AS_OF = "2024-06-01T12:00:00"


def rows(df, *cols):
    """Result rows as {pipeline: tuple(cols)}."""
    return {r["pipeline"]: tuple(r[c] for c in cols) for r in df.collect()}
