"""Tokenizer models, their loaders and merge kernels."""
