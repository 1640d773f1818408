"""lyrebird: speech-text analytics and corpus preparation, written for Spark DataFrames."""
