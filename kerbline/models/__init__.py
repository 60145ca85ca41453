"""Count and severity models on Spark MLlib."""
