"""topicflow: topic discovery and tracking over news corpora, on Spark DataFrames."""
