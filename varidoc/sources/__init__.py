"""Reading and writing documents."""
