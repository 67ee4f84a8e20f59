"""Column expressions shared by the datasets; none of them runs a job."""
