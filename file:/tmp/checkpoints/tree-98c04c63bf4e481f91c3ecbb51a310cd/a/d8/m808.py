x808