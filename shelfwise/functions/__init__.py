"""Column-expression helpers (text, vectors). All JVM-side, no Python UDFs."""
