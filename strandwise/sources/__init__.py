"""Tables of records: carriers over the given tables, sequence files, and archives."""
