"""Composed plans: profiling reports, the query catalogue, strategy search, ablation."""
