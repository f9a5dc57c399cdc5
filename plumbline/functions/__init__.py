"""Column expressions: text extraction, pricing, geometry. All stay inside Spark's own functions."""
