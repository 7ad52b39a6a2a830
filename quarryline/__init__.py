"""quarryline: Spark-native search and analytics over conversation transcripts."""
