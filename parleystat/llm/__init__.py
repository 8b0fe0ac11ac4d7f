"""Operators for preparing training text: archives, tokens, near copies, quality, secrets, languages, chat."""
