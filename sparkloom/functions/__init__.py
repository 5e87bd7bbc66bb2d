"""Column functions on expressions, names and identifiers, all inside the JVM."""
