"""An analytics engine on PySpark: pools, learners, metrics, event logs, text."""
