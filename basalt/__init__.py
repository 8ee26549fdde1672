"""A layered lakehouse engine on PySpark: landing, typing, merging, modelling, quality, streams."""
