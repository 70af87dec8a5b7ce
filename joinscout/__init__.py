"""joinscout: find, join and choose columns of a lake that help a base table, on Spark."""
