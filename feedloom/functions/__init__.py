"""Column expressions; the few that Spark's functions can't express are Arrow UDFs in ``arrow``."""
