"""Spark-native hybrid search, retrieval evaluation and corpus preparation.

Everything is a DataFrame-to-DataFrame operator: plans stay declarative so that
Catalyst, AQE and Tungsten choose the physical strategy.
"""

__version__ = "0.1.0"
