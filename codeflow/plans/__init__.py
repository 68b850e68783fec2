"""Analysis plans: discovery, call resolution, framework index, workspace analysis."""
