"""DataFrame operators: merge, star schema, analytics, data quality."""
