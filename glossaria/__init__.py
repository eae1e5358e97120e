"""Dictionary lookup and text analysis over whole corpora, as Spark jobs."""
