"""What keyloom decides before Spark plans: headings, restrictions, propagation along foreign keys."""
