"""Sources: tables, source trees, docs, commit logs, fact files."""
