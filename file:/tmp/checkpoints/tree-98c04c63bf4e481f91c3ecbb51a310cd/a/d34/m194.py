x194