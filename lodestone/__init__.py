"""lodestone: dataset analytics and document retrieval expressed as Spark DataFrames."""

__version__ = "0.1.0"
