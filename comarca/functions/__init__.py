"""Column functions: text repair, ids, labels, geometry. All are native expressions."""
