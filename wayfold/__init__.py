"""Analytics over movement traces on a street network, written for Spark."""
