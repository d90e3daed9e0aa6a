x464