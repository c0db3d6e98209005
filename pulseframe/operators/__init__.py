"""DataFrame operators over blocks, samples and dimension tables."""
