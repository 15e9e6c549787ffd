"""The four end-to-end jobs: generate, augment, documents to dataset, convert."""
