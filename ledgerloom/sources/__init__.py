"""Tables, files and the payment views derived from the supplied test tables."""
