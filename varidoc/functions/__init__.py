"""Column functions over documents: values, paths, arrays, dicts, text, numbers, dates."""
