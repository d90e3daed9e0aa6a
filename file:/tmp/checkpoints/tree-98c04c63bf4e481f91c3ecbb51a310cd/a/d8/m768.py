x768