"""Training-data operators: one module per operator, plus the driver queries in `queries.py`."""
