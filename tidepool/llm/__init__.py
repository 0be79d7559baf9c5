"""Training-data operators: filters, classifiers, near-duplicate joins, packing and archives."""
