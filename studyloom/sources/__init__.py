"""Where rows come from and go to: requests, jobs, corpus state, results, callbacks."""
