"""Column functions: time codes, event wording, log parsing, picture quality."""
