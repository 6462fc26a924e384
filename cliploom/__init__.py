"""Search, curation and evaluation of large collections of short clips, on Spark."""
