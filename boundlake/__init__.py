"""Boundlake: guaranteed-bound evaluation of uncertain calculations, and the
relational queries around it, as Spark DataFrames, SQL and streams."""
