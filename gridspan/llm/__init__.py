"""Training-data operators: ten corpus-scale jobs that nothing else in the library imports."""
