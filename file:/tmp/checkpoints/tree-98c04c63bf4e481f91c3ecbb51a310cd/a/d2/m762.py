x762