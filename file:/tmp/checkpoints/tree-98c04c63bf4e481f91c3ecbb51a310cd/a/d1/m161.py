x161