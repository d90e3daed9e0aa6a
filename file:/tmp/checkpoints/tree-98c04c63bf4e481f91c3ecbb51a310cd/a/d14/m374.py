x374