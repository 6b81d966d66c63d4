"""Training-data operators over documents, pages and labels; nothing outside this subpackage imports it."""
