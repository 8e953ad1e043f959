"""One builder per query, with the DuckDB SQL that must give the same rows where SQL can."""
