"""Series, run, matching and metric operators."""
