"""Scalar and array functions: Column expressions where Spark has the pieces, Arrow batches where it has not."""
