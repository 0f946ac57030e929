"""Column-expression helpers; everything here stays JVM-side (no UDFs)."""
