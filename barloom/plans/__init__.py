"""Ready-made compositions: the layered dataset, one security, SQL views."""
