"""DataFrame operators: deep walks, diff and patch, key dictionaries, keyed stores."""
