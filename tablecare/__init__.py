"""tablecare: table profiling, cleaning, exploration, name reconciliation,
target ranking and baseline models as Spark DataFrame operators."""

__version__ = "0.1.0"
