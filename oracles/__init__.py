"""DuckDB statements that state every registered query a second time."""

from oracles.network import NETWORK
from oracles.tables import TABLES

STATEMENTS = {**TABLES, **NETWORK}
