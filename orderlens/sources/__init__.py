"""Where data comes from and goes to: raw tables, databases, processed outputs."""
