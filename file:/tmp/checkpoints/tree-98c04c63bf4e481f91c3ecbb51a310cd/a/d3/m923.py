x923