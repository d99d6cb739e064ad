"""tallyline: evidence matching, curation and evaluation operators on Spark DataFrames."""
