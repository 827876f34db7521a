"""Training-text operators; nothing outside this package imports it."""
