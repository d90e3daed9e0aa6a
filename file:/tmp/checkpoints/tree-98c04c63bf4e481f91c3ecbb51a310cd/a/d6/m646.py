x646