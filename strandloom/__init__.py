"""Sequence-motif analytics as DataFrame-to-DataFrame operators on Spark."""
