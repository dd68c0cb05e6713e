"""Named queries over the driver's tables, each with DuckDB SQL where SQL can express it."""
