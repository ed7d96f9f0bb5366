"""Query catalogue and models."""
