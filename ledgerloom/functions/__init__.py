"""Pure Column builders and scalar parsers."""
