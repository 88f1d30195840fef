"""fieldlab: field-experiment and sensor-log analytics on Spark DataFrames.

Every operator takes and returns a DataFrame and has its column names as
arguments; nothing here holds rows on the driver.
"""
