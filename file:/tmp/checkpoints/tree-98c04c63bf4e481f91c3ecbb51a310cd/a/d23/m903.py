x903