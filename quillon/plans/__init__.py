"""How operators keep plans short and sides small."""
