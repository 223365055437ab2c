"""tabloom: arbitrary tables -> text samples for tabular prediction, on Spark.

Every operator takes and returns DataFrames (or builds Columns); see README.md for the map.
"""
