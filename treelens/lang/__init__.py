"""The query language: text on the driver to one Column for the executors."""
