x743