"""Geometry kernels and codecs. They run inside Arrow batches and know nothing of Spark."""
