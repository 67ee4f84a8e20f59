"""Stock reconciliation, sales and P&L datasets as Spark DataFrames."""
