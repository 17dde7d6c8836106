"""Time-series operators in batch and streaming form."""
