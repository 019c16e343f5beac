"""Composed plans: the registered query catalog, report bundles, materialisation."""
