"""Column-level building blocks; everything here stays in the JVM."""
