"""Changes of modules: what differs, how risky it is, and how rows follow."""
