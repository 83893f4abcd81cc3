"""Views over the supplied tables, and the queries on them with their oracles."""
