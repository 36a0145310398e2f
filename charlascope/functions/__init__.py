"""Column expressions: text folding, tokens, topics and slot signals."""
