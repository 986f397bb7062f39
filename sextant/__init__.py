"""Text retrieval, answer evaluation and their metrics as DataFrame functions."""
