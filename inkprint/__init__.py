"""inkprint: authorship attribution over text collections, as Spark jobs.

Every operator takes and returns DataFrames keyed by ``pid`` (one row per
document, or one row per (document, term)).  Nothing here collects a table to
the driver; fitted tables (vocabularies, profiles, models) are ordinary tables.
"""

__version__ = "0.1.0"
