"""tidemark: market-wide bar, event, fact and ledger analytics on Spark DataFrames."""
