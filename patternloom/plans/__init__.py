"""The store and the registered queries."""
