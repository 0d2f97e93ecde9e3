"""larkspur: security analytics over text, code and tool-call events, on Spark DataFrames."""
