x368