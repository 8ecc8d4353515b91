"""Operators for preparing large training corpora (token output, deduplication,
decontamination, packing, scoring, sanitisation, language ID, set joins)."""
