x446