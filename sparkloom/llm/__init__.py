"""Training-data operators: tokenising, mixing, search, rollups, fingerprints, filters and de-duplication.

Nothing else in the library imports this package.
"""
