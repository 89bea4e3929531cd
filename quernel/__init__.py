"""quernel: PySpark jobs for technical-document search and register facts."""
