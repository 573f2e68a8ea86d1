"""Learning analytics and early warning as plain Spark jobs."""

__version__ = "0.1.0"
