"""Rules to DataFrame plans, and the loops that run them."""
