"""Catalogs of tables and the plans over them."""
