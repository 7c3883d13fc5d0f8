"""rivalgrid: matchup and market analytics as Spark DataFrame operators."""
