"""Image operators: numpy kernels, and the DataFrame functions that run them in Arrow batches."""
