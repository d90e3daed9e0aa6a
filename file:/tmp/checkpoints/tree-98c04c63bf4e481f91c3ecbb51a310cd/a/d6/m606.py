x606