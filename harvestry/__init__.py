"""harvestry: Spark-first analytics over harvested "what's on" listings."""

__version__ = "0.1.0"
