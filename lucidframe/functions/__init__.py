"""Column functions: hashing, vectors, chunking, answer parsing."""
