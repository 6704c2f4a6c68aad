"""Multi-operator plans: episode replay, reachability, batch policies."""
