"""Sources: typed tables bound to a schema, and JSON documents."""
