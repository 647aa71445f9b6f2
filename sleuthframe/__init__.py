"""sleuthframe: forensic evidence analytics on PySpark DataFrames."""
