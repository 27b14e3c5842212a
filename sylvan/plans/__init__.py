"""Trees, models, the training loop and its configuration."""
