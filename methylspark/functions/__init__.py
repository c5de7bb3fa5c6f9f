"""Part of methylspark; see the modules."""
