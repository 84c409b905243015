"""Column expressions; no function here touches the session or runs a job."""
