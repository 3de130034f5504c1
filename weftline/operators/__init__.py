"""DataFrame operators: linking, uniqueness, audits, queries, mutations, coverage."""
