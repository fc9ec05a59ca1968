"""Column functions: narrow, shuffle-free, evaluated inside the JVM."""
