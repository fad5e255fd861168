"""Sources: flow tables in CSV and Parquet, packet captures, catalogues of files."""
