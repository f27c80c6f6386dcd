"""cambium: a Spark-native engine for code graphs and the data pipelines around them."""
