"""Contract tables derived from the generic star-schema test tables, and reference SQL for them."""
