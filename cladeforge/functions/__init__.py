"""Column functions over sequences, and Arrow functions for alignment."""
