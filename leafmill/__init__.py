"""A Spark engine for book-scale documents: cleaning, structure, batching, cost, quality screens and reports."""
