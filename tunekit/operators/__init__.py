"""DataFrame operators: parsing, chunking, prompts, inference, validation, quality and reports."""
