"""A PySpark engine for retail price intelligence."""
