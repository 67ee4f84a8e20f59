"""The same results in SQL for another engine, to check the datasets and reports against."""
