"""Named queries: each applies operators to the shared tables, beside the SQL that checks it."""
