"""Where documents, tables and graphs come from and go to."""
