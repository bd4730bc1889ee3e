"""Column functions: pure expressions, all evaluated inside the JVM."""
