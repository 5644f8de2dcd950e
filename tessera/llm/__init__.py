"""Training-data operators (see the README's table); nothing else in the library imports this subpackage."""
