"""vaultframe: versioned, content-deduplicated data on Spark DataFrames."""
