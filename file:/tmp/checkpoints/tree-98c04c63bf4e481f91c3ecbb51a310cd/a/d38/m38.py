x38