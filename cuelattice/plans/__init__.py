"""Session set-up and the pipeline driver."""
