"""The watched folder: new files become runs."""
