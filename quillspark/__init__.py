"""quillspark: document, termbase and translation-memory analytics as DataFrame operators."""
