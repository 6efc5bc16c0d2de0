"""Panel, moment, boosting, tree, VAR and pairwise operators."""
