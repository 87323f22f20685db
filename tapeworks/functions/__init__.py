"""Column expressions: every function takes and returns a Spark Column."""
