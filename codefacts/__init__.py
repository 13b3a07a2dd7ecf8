"""codefacts: source code and text corpora analysed as Spark DataFrames."""
