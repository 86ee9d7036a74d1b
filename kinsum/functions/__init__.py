"""Column-expression helpers shared by the metric builders (all JVM-side)."""
