"""Analytics over weighted, categorised points and ordered numeric series, written as Spark DataFrame plans."""
