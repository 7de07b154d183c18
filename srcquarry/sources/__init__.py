"""Sources: repository trees, parser output, API descriptions, manifests."""
