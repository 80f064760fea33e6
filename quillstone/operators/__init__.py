"""DataFrame operators over pages, tables, headers, documents and events."""
