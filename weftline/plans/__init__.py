"""Planning over the model: insertion order and row counts."""
