"""Analytics over object-detection annotations as lazy Spark plans."""
