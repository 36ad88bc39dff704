"""The layered models: staging, intermediate, marts, observability, and the registry that builds them."""
