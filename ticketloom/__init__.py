"""Support-ticket triage analytics on Spark DataFrames."""
