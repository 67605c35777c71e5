"""Operators for training-data pipelines, one module each, and their registered queries.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is present."""
