"""DataFrame operators: ordering, session windows, retrieval, judgement, validation, reports and roll-ups."""
