"""A PySpark engine that scores transactions by their nearest labelled neighbours."""
