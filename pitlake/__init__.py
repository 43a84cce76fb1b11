"""pitlake: point-in-time features, evaluation and squad analytics on panel tables, as lazy Spark plans."""
