"""quillspark: document analytics and retrieval operators on PySpark DataFrames."""
