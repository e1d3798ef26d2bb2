"""Analytics over versioned file trees, chunk manifests and text corpora, as Spark DataFrames."""
