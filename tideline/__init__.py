"""tideline: ordered analytics and training-data operators on PySpark."""
