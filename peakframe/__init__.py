"""Spark-first analytics for peak lists, matches, pair graphs, sequences and text corpora."""
