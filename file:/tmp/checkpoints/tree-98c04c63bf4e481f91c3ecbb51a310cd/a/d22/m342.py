x342