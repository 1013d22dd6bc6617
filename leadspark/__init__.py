"""Review-lead detection over public-interest tables, written as Spark DataFrame jobs."""

__version__ = "0.1.0"
