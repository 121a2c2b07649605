"""Logical views over the driver tables, composed jobs and the registered queries."""
