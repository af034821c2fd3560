"""Sources and sinks: uploads, tables, JSONL, vector collections, event feeds, settings, model connectors."""
