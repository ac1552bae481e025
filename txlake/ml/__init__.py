"""Trained fraud model: features, isolation forest, boosted trees, ensemble."""
