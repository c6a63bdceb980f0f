"""Composed plans: dataset build, training preparation, profiling."""
