"""Corpus preparation for language-model training. Nothing else imports it."""
