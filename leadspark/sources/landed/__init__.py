"""Jobs that reshape landed raw dumps (nested JSON, CSV, XML) into contract tables.

Every job takes DataFrames read with the schema given next to it and returns
contract tables. Nothing is fetched.
"""
