"""Column functions: text, entities, URLs, dates, analysis payloads and page HTML."""
