"""Part of the prospect analytics engine."""
