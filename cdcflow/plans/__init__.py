"""What a synchronisation is made of, and the registered queries."""
