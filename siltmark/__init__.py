"""siltmark: curate, stress-test and evaluate labelled tables and streams on Spark."""

__version__ = "0.1.0"
