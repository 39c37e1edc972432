"""Declarative descriptions of filters, scopes and rules, compiled to columns on the driver."""
