"""kpispark: business time-series KPIs, rollups, accuracy tables and tree
forecasts expressed as Spark DataFrame plans.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark SQL
expressions, windows, joins and aggregations, so Catalyst plans the work and
it runs distributed.  Sub-packages:

* ``functions``  - Column -> Column expressions (KPIs, calendar, guards)
* ``sources``    - readers, writers and the adapter over the driver tables
* ``operators``  - KPI summaries, rollups, features, metrics, models, forecasts
* ``plans``      - the registered queries and their DuckDB oracle SQL
"""

__version__ = "0.1.0"
