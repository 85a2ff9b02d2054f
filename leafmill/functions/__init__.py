"""Row-wise text functions as Column expressions."""
