"""Column functions: text, scores, trees of tokens, and the word lists they use."""
