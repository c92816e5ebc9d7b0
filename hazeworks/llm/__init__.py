"""Training-data operators: one module per operator, joined to the driver's contract in ``queries``."""
