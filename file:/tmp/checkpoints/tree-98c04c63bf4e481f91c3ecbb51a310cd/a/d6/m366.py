x366