"""CI-failure analytics on Spark: log condensation, scoring, gating, curation and patch text work."""
