"""Configuration, query pipeline, searcher, service and distributed builds."""
