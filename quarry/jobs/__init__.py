"""Jobs over catalogs and evaluation results."""
