"""Column expressions. Nothing here leaves the JVM."""
