"""PostgreSQL-flavoured SQL front end."""
