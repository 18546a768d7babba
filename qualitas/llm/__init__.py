"""Training-data operators: thirteen operators, their registered queries and the SQL that checks them."""
