"""Search spaces, proposals, budgets and the study loop: the control plane on the driver."""
