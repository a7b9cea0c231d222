"""Query plans: the warehouse of raw tables and marts, the query catalog and
the independent SQL answers used to check it."""
