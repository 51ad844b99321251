"""tessera: Spark-native corpus preparation, model-output evaluation and
experiment-log analytics.

Every public operator is a function ``DataFrame -> DataFrame`` (or
``Column -> Column`` for scalar helpers) that only declares a logical plan;
Catalyst and AQE choose the physical strategy.
"""

__version__ = "0.1.0"
