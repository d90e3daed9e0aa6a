x750