"""Part of the place-analytics engine."""
