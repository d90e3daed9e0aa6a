x69