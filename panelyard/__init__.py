"""Cross-sectional panel analytics, written as Spark DataFrame plans."""
