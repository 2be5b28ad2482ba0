"""Plan-level helpers: scratch tables, routing plans and DDL documents."""
