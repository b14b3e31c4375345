"""mailweave: turn stored web pages and text into clean contact tables on Spark."""

__version__ = "0.1.0"
