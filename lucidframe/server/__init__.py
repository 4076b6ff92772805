"""A server for the PostgreSQL wire protocol, simple queries only."""
