"""Training-data operators: each module holds one operator; nothing outside imports this package."""
