"""loamwork: a PySpark engine for schema discovery, profiling, normalisation and routing of raw data."""
