"""Column expressions: everything here runs inside Spark's JVM operators."""
