"""A PySpark engine for calculated fields, view queries and training-data pipelines."""
