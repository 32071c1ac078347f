"""Reading deliveries and bundles, keeping the state tables."""
