"""stayframe: turn timestamped measurement events into forecasting datasets on Spark.

Every public function maps DataFrame(s) to a DataFrame and stays lazy; the only
driver-side values are column lists, scaler constants, distinct category lists
and metric scalars.
"""

__version__ = "0.1.0"
