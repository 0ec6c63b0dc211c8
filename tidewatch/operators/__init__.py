"""DataFrame operators: patterns, features, rules, scores, cases."""
