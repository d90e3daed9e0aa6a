x715