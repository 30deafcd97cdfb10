"""Knowledge-bundle and event-ledger analytics on Spark DataFrames."""
