"""A PySpark engine for checking and curating text records."""
