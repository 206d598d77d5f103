"""Part of the loomdex engine."""
