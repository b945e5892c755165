"""Compositions: components, the index, plot-ready frames, the test-data cube."""
