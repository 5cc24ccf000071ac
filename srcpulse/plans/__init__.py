"""User-level pipelines, the query catalogue and its SQL oracle."""
