"""Where rows come from and go to: test tables, change logs, archives and the shared working folder."""
