"""Sources: image listings, archives, token tables and recognisers."""
