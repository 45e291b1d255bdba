"""Training-data operators on document tables; nothing else in the library imports them."""
