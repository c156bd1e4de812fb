"""Training-data operators: decontamination, toxicity, token counts, language
ID, near-duplicate joins, packing, substring de-duplication, fingerprints,
archives and URL filters.  Nothing else in the library imports this package."""
