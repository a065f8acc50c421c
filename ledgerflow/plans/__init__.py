"""Composed plans: data preparation (the end-to-end build of buckets,
splits, encoders, sequences and targets) and the registered query catalog."""
