"""Reading files and tables, writing reports and run tables."""
