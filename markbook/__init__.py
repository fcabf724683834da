"""markbook: rubric grading and the data work around it, as Spark DataFrame operators."""

__version__ = "0.1.0"
