"""Column expressions: text keys, model names, generated text, numbers."""
