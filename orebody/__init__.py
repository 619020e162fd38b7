"""PySpark-native data-mining engine: every operator takes and returns DataFrames."""
