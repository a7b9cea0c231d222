"""DataFrame operators: staging, marts, charts, analyses, models, text checks."""
