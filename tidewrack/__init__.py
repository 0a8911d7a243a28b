"""tidewrack: a findings engine built on Spark SQL."""
