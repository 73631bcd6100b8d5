"""Check data, check queries and their SQL; not part of the library."""
