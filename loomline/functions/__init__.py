"""Column-level building blocks; all of them stay in the JVM."""
