"""Column functions: paths, terms, dates, identifiers, attribute values, units."""
