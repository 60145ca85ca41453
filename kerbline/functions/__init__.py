"""Column expressions; all of them stay inside JVM code generation."""
