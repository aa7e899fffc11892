"""Reading tables and folders."""
