"""castlist: names in text corpora, found, counted, ranked and replaced on Spark."""
