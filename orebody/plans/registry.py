"""Every query of the core, with the SQL it is checked against."""

from __future__ import annotations

from orebody.plans import core, core_sql, files, spatial

QUERIES = {**core.QUERIES, **files.QUERIES, **spatial.QUERIES}
SQL = {**core_sql.SQL, **files.SQL, **spatial.SQL}
FLAGSHIP = core.state_avg
