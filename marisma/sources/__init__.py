"""Sources: tables, feeds, pages, files."""
