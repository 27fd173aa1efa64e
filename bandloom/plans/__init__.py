"""Jobs over stored tables, the derived spot table, and the registered queries."""
