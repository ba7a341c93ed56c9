"""Column functions on sequences, qualities and headers. All are Catalyst expressions without Python on executors."""
