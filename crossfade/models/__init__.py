"""MLlib regressors and mixed-effects models."""
