"""The interfaces of other tokenizer libraries."""
