"""Training-data operators and their registered queries (nothing else imports this package)."""
