"""piitrace: incident-log analytics on Spark DataFrames."""
