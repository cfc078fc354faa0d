"""Relation analytics over annotated and parsed text, and corpus operators, as Spark plans."""
