"""Recording analytics on Spark: functions from DataFrame to DataFrame over keyed tables of recordings, events and signals.

Every recording's key is a column, so one plan serves one recording or a hundred thousand.
"""
