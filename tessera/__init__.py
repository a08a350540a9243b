"""tessera: a Spark-native analytics engine for typed, time-stamped text memories."""
