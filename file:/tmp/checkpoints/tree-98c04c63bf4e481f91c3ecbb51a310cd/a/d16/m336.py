x336