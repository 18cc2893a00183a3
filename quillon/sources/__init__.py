"""Reading and writing: COPY, tables, samples, snapshots and packages."""
