"""Query front-ends and the catalogue of registered queries."""
