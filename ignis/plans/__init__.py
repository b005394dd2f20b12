"""Named compositions of operators over the fixture views (``views``), the
registered queries (``queries``) and their DuckDB oracle SQL (``oracle``)."""
