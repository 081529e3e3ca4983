"""Analytics over reactive network-telescope logs, written as Spark DataFrame transformations."""
