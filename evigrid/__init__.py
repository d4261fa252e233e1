"""Evidence-graph analytics on Spark: declarative DataFrame operators over claims, sources and decisions."""
