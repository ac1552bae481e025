"""Lake layers, keyed tables, logs and published messages."""
