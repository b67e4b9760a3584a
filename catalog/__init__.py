"""The registered queries: each operator applied to the supplied tables, with its SQL check."""
