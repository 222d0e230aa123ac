"""Column functions: everything here is a JVM expression over one row."""
