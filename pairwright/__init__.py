"""pairwright: sequence-corpus curation, preference pairs, ranking and
evaluation as Spark DataFrame jobs."""

__version__ = "0.1.0"
