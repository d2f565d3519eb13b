"""Small constant tables that joins broadcast."""
