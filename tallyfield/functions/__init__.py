"""Column helpers, distributed ordering and the small numeric kernels used inside tasks."""
