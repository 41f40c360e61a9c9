"""Functions of the formula language as builders of Spark columns."""
