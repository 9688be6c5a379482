"""Jobs made of several operators, and the queries registered for the driver."""
