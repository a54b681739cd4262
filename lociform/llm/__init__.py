"""Training-data operators: text quality, language, tokens, URLs, scoring, overlap and mixing."""
