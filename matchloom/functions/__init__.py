"""Column expressions shared by the catalogue and the item jobs."""
