"""Training-data operators: mixing, fingerprints, language, URL rules, archives, dedup, quality, decontamination, token files."""
