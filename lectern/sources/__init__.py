"""Sources and sinks of the knowledge base."""
