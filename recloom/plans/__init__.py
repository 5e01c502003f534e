"""Registered queries: each operator applied to the driver's tables, with SQL that says the same where SQL can."""
