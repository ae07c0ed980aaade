"""The rule language: text to checked rules."""
