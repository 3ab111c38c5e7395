"""Column expressions: text, JSON and chat helpers that stay inside the JVM."""
