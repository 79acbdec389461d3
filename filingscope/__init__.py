"""filingscope: event-study operators for public trade disclosures, on Spark DataFrames."""
