"""The user-visible results, composed from the operators."""
