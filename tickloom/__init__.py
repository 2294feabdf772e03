"""Time-ordered analytics on Spark DataFrames: bars, signals, ledgers, diagnostics."""
