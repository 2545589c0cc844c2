"""Training-data operators: dedup, decontamination, language, quality, tokens, fingerprints.

Nothing outside this subpackage imports it; ``queries.py`` registers its queries.
"""
