x950