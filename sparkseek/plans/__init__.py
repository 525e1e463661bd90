"""Query language: parsing and compilation to Catalyst columns."""
